import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_classifiers import prose
from tests.llm.test_mixing import wanted
from tests.llm.test_ngram_join import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(9)
    sf = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for k in range(240):
        text = prose(rng, rng.randint(8, 80))
        if k % 6 == 5:
            text = rows[-1][1]
        elif k % 6 == 4:
            text = rows[-1][1] + " tail"
        toxic = k % 5 == 0
        if toxic:
            text = "idiot " + text + " moron"
        if k % 7 == 0:
            text += " token = abcdef0123456789abcdef"
        rows.append((k, text, "en", f"s{k % 4}" if k % 9 else None, len(text)))
        labels.append((k, 1, int(toxic)))
    rows += [(900, None, None, "s1", None), (901, "", "en", "s1", 0), (None, rows[1][1], "en", "s2", 5), rows[2], rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        made = f(spark, docs, str(sf))
        made.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        out.append((docs.columns, [tuple(r) for r in docs.collect()]))
    return rows, out


def test_each_stage_equals_its_plain_version(spark, stages):
    import sentencepiece

    rows, out = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scan", "source_mixing", "sentencepiece"]
    assert all(cols == ["doc_id", "text", "lang", "source", "n_chars"] for cols, _ in out[:4])
    clean = [r for r in rows if "idiot" not in (r[1] or "")]
    assert sorted(out[0][1], key=str) == sorted(clean, key=str)
    component = {k: c for k, _, c in brute([(r[0], r[1]) for r in clean if r[0] is not None])}
    alone = list(dict.fromkeys(r for r in clean if r[0] is None or component[r[0]] == r[0]))
    assert sorted(out[1][1], key=str) == sorted(alone, key=str)
    hide = lambda t: None if t is None else re.sub("token = [a-z0-9]+", "[SECRET]", t)
    hidden = [(k, hide(t), lang, s, None if t is None else len(hide(t))) for k, t, lang, s, _ in alone]
    assert sorted(out[2][1], key=str) == sorted(hidden, key=str) and any(r[0] is None for r in hidden)
    size, z, target = wanted([(r[0], r[1], r[3]) for r in hidden])
    for s in z:
        taken = sum(len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for r in out[3][1] if r[3] == s)
        assert abs(taken - target[s]) <= 90
    assert set(out[3][1]) <= set(hidden) and max(out[3][1].count(r) for r in set(out[3][1])) <= 2
    piece = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    want = sorted(((r[0], r[3], tuple(piece.encode(r[1] or ""))) for r in out[3][1]), key=str)
    got = sorted(((r[0], r[1], tuple(r[2])) for r in out[4][1]), key=str)
    assert got == want and all(len(r[2]) == r[3] for r in out[4][1]) and len(out[4][1]) == len(out[3][1])
