import pytest
from pyspark.sql import functions as F

from reflume import schema
from reflume.operators import explore, metrics, report, rules
from reflume.operators.regions import balanced_regions
from reflume.plans import lint
from reflume.sources.corpus import long_manuscripts

ENTRY = "{}, {} ({}). Structured citations. Journal of Citation Science, 12(3), 45-60."


def blocks(spark, docs):
    rows = []
    for doc, parts in docs.items():
        for k, part in enumerate(parts):
            kind, text = part if isinstance(part, tuple) else ("paragraph", part)
            rows.append((doc, k, f"doc-p{k}", kind, text, None, k, None))
    return spark.createDataFrame(rows, schema.BLOCKS)


H = ("heading", "References")
DOCS = {
    "plain": [("heading", "Introduction"), "Doe (2018) and then", "more of Doe (2021).", H, ENTRY.format("Doe", "J.", 2018), ENTRY.format("Doe", "J.", 2019)],
    "ambiguous": ["Smith (2020) said.", "x", "y", H, ENTRY.format("Smith", "J.", 2020), "Smith, J. (2020). Other. Press, 1(2), 3-4."],
    "vietnamese": ["by Nguyễn, V. A. (2015) it was.", "of Đỗ (2018) too.", "x", H, ENTRY.format("Nguyen", "V. A.", 2015), ENTRY.format("Do", "Q.", 2018)],
    "conflict": ["by Smith, J. (2019) it was.", "x", "y", H, ENTRY.format("Smith", "P.", 2019)],
    "numeric": ["[1], [5], [0]", "[1, x] and [2-3]", "y", H, ENTRY.format("Doe", "J.", 2017), ENTRY.format("Roe", "M.", 2018), ENTRY.format("Poe", "K.", 2019)],
    "none": ["Doe (2017) is cited."],
    "below": [H, "prose follows", "and more", "x", "y"],
    "junk": ["[1]", "[1, x]", "z", H, "Junk without a year.", ENTRY.format("Doe", "J.", 2017), ENTRY.format("Roe", "M.", 2018)],
    "notes": [("footnote", "Doe (2017) in a note."), ("heading", "Danh mục tài liệu tham khảo"), ENTRY.format("Doe", "J.", 2017)],
}


@pytest.fixture(scope="module")
def ctx(spark):
    return lint.analyse(blocks(spark, DOCS))


def by_doc(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in cols))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_sections(ctx):
    got = {r.doc_id: r for r in ctx.documents.collect()}
    assert {k for k, r in got.items() if r.outcome == "detected"} == {"plain", "ambiguous", "vietnamese", "conflict", "numeric", "junk", "notes"}
    assert got["none"].outcome == "none" and got["below"].outcome == "below-threshold" and got["below"].confidence == 0.5
    n = {k: len(v) for k, v in by_doc(ctx.entries, "entry_index").items()}
    assert n == {"plain": 2, "ambiguous": 2, "vietnamese": 2, "conflict": 1, "numeric": 3, "junk": 3, "notes": 1}


def test_matches(ctx):
    rows = ctx.citations.join(ctx.matches, ["doc_id", "ord"]).select("doc_id", "raw", "relationship", "score", "tier", "reasons")
    got = {(r.doc_id, r.raw): r for r in rows.collect()}
    assert (got["plain", "Doe (2018)"].relationship, got["plain", "Doe (2018)"].score) == ("MATCHED", 1.0)
    assert (got["plain", "Doe (2021)"].relationship, got["plain", "Doe (2021)"].score) == ("POSSIBLE_MISMATCH", 0.6)
    assert got["ambiguous", "Smith (2020)"].relationship == "AMBIGUOUS"
    assert (got["vietnamese", "Nguyễn, V. A. (2015)"].score, got["vietnamese", "Nguyễn, V. A. (2015)"].tier) == (0.845, 3)
    assert (got["vietnamese", "Đỗ (2018)"].score, got["vietnamese", "Đỗ (2018)"].tier) == (0.6, 5)
    assert got["conflict", "Smith, J. (2019)"].score == 0.525 and "given-initial-mismatch" in got["conflict", "Smith, J. (2019)"].reasons
    assert got["none", "Doe (2017)"].relationship == "MISSING_REFERENCE"


def test_issues(ctx):
    counts = {}
    for r in rules.run_rules(ctx).collect():
        counts.setdefault(r.doc_id, {}).setdefault(r.rule_id, []).append(r)
    assert {k: len(v) for k, v in counts["junk"].items()} == {"CS006": 1, "CS007": 1, "CS002": 1}
    assert set(counts["none"]) == {"CS001"} and {k: len(v) for k, v in counts["ambiguous"].items()} == {"CS004": 3, "CS005": 2}
    assert {k: len(v) for k, v in counts["numeric"].items()} == {"CS007": 1, "CS008": 2}
    assert counts["numeric"]["CS008"][0].message == "Missing numeric reference: index 5 is out of range (the bibliography has 3 entries)."
    assert counts["plain"]["CS003"][0].message == "Possible year mismatch: citation 'Doe (2021)' year (2021) does not match the reference entry year."


def test_order_overrides_and_own_rules(ctx):
    own = rules.Rule("X1", "INFO", lambda c: c.blocks.where("type = 'heading'").select("doc_id", "block_id", F.lit("heading").alias("message")))
    rows = rules.ordered(rules.run_rules(ctx, enabled=["numeric"], overrides={"cs007": "error", "CS007": "Error", "CS008": "loud"}, custom=[own])).where("doc_id = 'numeric'").orderBy("position").collect()
    assert [(r.rule_id, r.severity) for r in rows] == [("CS008", "ERROR"), ("CS008", "ERROR"), ("CS007", "ERROR"), ("X1", "INFO")]
    with pytest.raises(TypeError):
        rules.run_rules(ctx, custom=[rules.Rule("CS001", "INFO", lambda c: c.blocks)])
    with pytest.raises(TypeError):
        rules.Rule("X", "LOUD", lambda c: c.blocks)


def test_recovery(spark):
    b = blocks(spark, {"below": [H, "prose follows", ENTRY.format("Doe", "J.", 2017), "tail"], "gone": ["a"]})
    chosen = spark.createDataFrame([("below", ["doc-p0"]), ("gone", ["nope"])], "doc_id string, block_ids array<string>")
    ctx = lint.analyse(b, lint.Options(bibliography_blocks=chosen), keep=False)
    assert {r.doc_id: (r.outcome, r.confidence) for r in ctx.documents.collect()} == {"below": ("detected", None), "gone": ("detected", None)}
    assert [(r.doc_id, r.raw[:5]) for r in ctx.entries.orderBy("entry_index").collect()] == [("below", "prose"), ("below", "Doe, ")]


def test_reports(ctx):
    rows = report.report_rows(ctx, rules.ordered(rules.run_rules(ctx)))
    values = {r["doc_id"]: report.report(r.asDict(recursive=True)) for r in rows.collect()}
    assert all(report.validate(v) == [] for v in values.values()) and report.exit_code(values["notes"]) == 0 and report.exit_code(values["none"]) == 1
    assert values["numeric"]["meta"] == {"file": "numeric", "citations": 7, "references": 3, "ruleIds": rules.active_rules()}
    assert {r.doc_id: r.json for r in report.report_json(rows).collect()}["none"] == report.serialize(values["none"])
    assert "</script><" not in report.render_html({**values["none"], "meta": {"file": "</script><b>"}}).split("<script")[1].replace("</script></body>", "")
    assert report.validate({"version": 2}) and report.exit_code(report.error_report("f", "NotADocxError", "x")) == 2


def test_explore(spark, ctx):
    issues = rules.ordered(rules.run_rules(ctx))
    marks = {(r.doc_id, r.issue_id): r for r in explore.highlights(ctx, issues).collect()}
    assert marks["numeric", "CS008:0"].mark == "5" and marks["none", "CS001:0"].mark == "Doe (2017)"
    refs = {(r.doc_id, r.issue_id): r.entry_indexes for r in explore.possible_references(ctx, issues).collect()}
    assert refs["ambiguous", "CS004:0"] == [0, 1]
    picks = spark.createDataFrame([("ambiguous", "c0", 1), ("ambiguous", "c1", 9), ("plain", "c0", 0)], "file string, citation_id string, choice int")
    chosen, counts = explore.apply_resolutions(ctx, issues, picks)
    assert [tuple(r) for r in chosen.collect()] == [("ambiguous", "c0", 1)] and [tuple(r) for r in counts.collect()] == [("ambiguous", "AMBIGUOUS", 1)]
    log = [("f", 1, "resolve", "c0", 5), ("f", 2, "clear", None, None), ("f", 3, "resolve", "c1", 7), ("f", 4, "resolve", "c1", 8)]
    latest = explore.latest_resolutions(spark.createDataFrame(log, "file string, seq int, action string, citation_id string, choice int"))
    assert [tuple(r) for r in latest.collect()] == [("f", "c1", 8)]


def test_regions_equal_a_stack(spark):
    import random

    from reflume.functions.grammar import regions

    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("()ab é") for _ in range(rng.randint(0, 30)))) for k in range(200)]
    got = by_doc(balanced_regions(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id"), "open_offset", "close_offset", "inner")
    want = {k: sorted([(a, b, t[a + 1 : b - 1]) for a, b in regions(t)], key=str) for k, t in rows}
    assert got == {k: v for k, v in want.items() if v}


def test_metrics(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x",), ("z",)], "k string")
    assert tuple(metrics.precision_recall(metrics.multiset_overlap(a, b, ["k"])).first()) == (1 / 3, 0.5, 2)
    assert tuple(metrics.precision_recall(metrics.multiset_overlap(a.limit(0), b.limit(0), ["k"])).first()) == (1.0, 1.0, 0)
    t = metrics.timing(spark.range(1, 9).selectExpr("'g' as g", "double(id) as v"), ["g"], "v").first()
    assert (t.median, t.p95) == (4.5, 8.0)


def test_long_numbers_are_out_of_range(spark):
    ctx = lint.analyse(blocks(spark, {"d": ["[20240101123456]", "[" + "9" * 5000 + "]", "x", H, ENTRY.format("Doe", "J.", 2017)]}), keep=False)
    assert sorted((r["index"], r.status) for r in ctx.tokens.collect()) == [(20240101123456, "out-of-range"), (10**18, "out-of-range")]


def test_release_lets_go_of_all_tables(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ctx = lint.analyse(blocks(spark, DOCS))
    rules.run_rules(ctx).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() > before
    lint.release(ctx)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before and not ctx.held


def test_long_manuscripts(spark):
    ctx = lint.analyse(long_manuscripts(spark, 2, entries=5, citations=23, paragraphs=9), keep=False)
    assert {r.doc_id: r["count"] for r in ctx.citations.groupBy("doc_id").count().collect()} == {"0": 28, "1": 28}
    assert {r.relationship for r in ctx.matches.select("relationship").distinct().collect()} == {"MATCHED"}
