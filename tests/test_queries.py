import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reflume import queries, schema
from reflume.functions import grammar, recalled
from reflume.operators import bibliography, citations
from reflume.sources.corpus import manuscripts


@pytest.fixture(scope="module")
def blocks(spark):
    texts = ["Shown (Doe, 2001) and [1, x], [2].", None, "no mark", "As [3] says (Roe, 1999).", "Shown (Doe, 2001) and [1, x], [2].", "Shown (Doe, 2001) and [1, x], [2]."]
    rows = [(str(k % 2), k, f"p{k}", "paragraph", t, None, k, None) for k, t in enumerate(texts)] + [("1", 9, "p9", "paragraph", None, None, 9, ["CITATION Smi10"])]
    return spark.createDataFrame(rows, schema.BLOCKS)


def test_possible_references_keeps_no_table_by_its_result(spark):
    df = queries.possible_references(spark, "/root/testdata/sf0.001").select("doc_id", "issue_id", "entries")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and len(plan) < 20_000
    assert df.count() == df.select("doc_id", "issue_id").distinct().count() > 0


def test_kinds_and_columns_are_parts_of_the_whole(blocks):
    whole = citations.extract(blocks)
    for kinds, cond in ((("invalid",), "kind = 'invalid'"), (("numeric",), "family = 'numeric'"), (("author-date",), "family = 'author-date'")):
        cols = ["doc_id", "block_ord", "kind", "start", "nth"]
        part = citations.extract(blocks, kinds, cols)
        assert part.columns == [c for c in whole.columns if c in cols]
        assert sorted(part.select(cols).collect()) == sorted(whole.where(cond).select(cols).collect()) != []


def test_recalled_texts_give_equal_results():
    text = "Shown (Doe, 2001; Roe, n.d.) and [1, x], [2-3]."
    first = recalled.found(text)
    memory = recalled.Memory(recalled.found)
    got = [memory(text) for _ in range(4)]
    assert got == [first] * 4 and text in memory.new and got[2] is not got[3]
    got[2].clear()
    assert memory(text) == first
    assert recalled.Memory(grammar.entry)("Doe, J. (2001). Title.") == grammar.entry("Doe, J. (2001). Title.")


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(recalled, "MOST_BYTES", 100_000)
    memory = recalled.Memory(lambda t: t * 2)
    for k in range(1000):
        assert memory(f"text {k}") == memory(f"text {k}") == f"text {k}text {k}"
    assert memory.size <= 50_000 and len(memory.new) + len(memory.old) < 500


def test_detected_sections_are_those_of_the_heads(spark):
    blocks = manuscripts(spark, "/root/testdata/sf0.001")
    found = bibliography.detect(blocks)
    heads = found.where("outcome = 'detected'").select("doc_id", F.col("block_id").alias("head_id"))
    cols = ["doc_id", "block_id", "section_ord"]
    assert sorted(bibliography.sections(blocks, heads).collect()) == sorted(bibliography.detected_sections(blocks).select(cols).collect()) != []


def test_numbers_alone_read_no_entries(spark):
    plan = queries.numeric_binding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_confidence" not in plan and "InMemoryRelation" not in plan


def test_rows_of_texts_that_come_again_are_taken_from_columns(monkeypatch):
    schema, calls = pa.schema([("text", pa.string()), ("nth", pa.int32()), ("parts", pa.list_(pa.string()))]), []

    def work(text):
        calls.append(text)
        return [{"text": text, "nth": k, "parts": [text, None] * k} for k in range(len(text) % 4)]

    def check(store, texts):
        at, rows = store(texts)
        got = sorted(zip(at.tolist(), (r["nth"] for r in rows.to_pylist()), map(str, rows.to_pylist()), strict=True))
        assert got == [(k, r["nth"], str(r)) for k, t in enumerate(texts) for r in work(t)]

    store = recalled.Rows(work, schema)
    assert store([])[1].num_rows == store(["none"])[1].num_rows == 0
    rounds = [[f"{'x' * (k % 7)}{(k * 7 + j) % 40}" for k in range(60)] + ["", "same text", "same text"] for j in range(30)]
    for texts in rounds:
        check(store, texts)
    calls.clear()
    store(rounds[-1])
    assert calls == [] and len(store.chunks) < 10
    monkeypatch.setattr(recalled, "MOST_HELD", 2_000)
    store = recalled.Rows(work, schema)
    for texts in rounds:
        check(store, texts)
    assert len(store.numbers) < 200


def test_stores_of_a_worker_are_few():
    for k in range(10):
        recalled.rows(k, lambda t: [], pa.schema([]))
    assert list(recalled._STORES) == [7, 8, 9]
    recalled._STORES.clear()


def test_citation_items_need_no_numbers(spark):
    plan = queries.citation_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "initials" not in plan


def test_cited_items_are_those_of_the_citations(blocks):
    item = citations.extract(blocks, ("author-date",)).select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.first_author", "i.year", "i.page")
    told = lambda df: sorted(map(str, df.collect()))
    assert told(citations.cited_items(blocks)) == told(item) != []
