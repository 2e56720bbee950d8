import json

from pyspark.sql import functions as F

from reflume import protocol
from reflume.operators import metrics, report, resolutions, rules
from reflume.plans import lint
from tests.test_docx import STYLES, p, package
from tests.test_engine import ENTRY, H, blocks


def issue(**more):
    place = {"blockId": "doc-p0", "paragraphIndex": 0, "startOffset": 2, "endOffset": 7}
    return {"id": "CS001:0", "ruleId": "CS001", "severity": "ERROR", "message": "m", "evidence": [{"code": "no-entry", "message": "e", "source": {"blockId": "doc-p9"}}], "sourceLoc": place} | more


def value(*issues):
    out = report.empty_report("f.docx")
    counts = {s: sum(i["severity"] == s for i in issues) for s in out["counts"]}
    return out | {"issues": list(issues), "counts": counts}


def test_offsets_are_utf16_units(spark):
    ctx = lint.analyse(blocks(spark, {"wide": ["😀😀 Doe (2017) said.", H, ENTRY.format("Roe", "J.", 2001)], "narrow": ["é: Doe (2017) said."]}), keep=False)
    rows = report.report_rows(ctx, rules.ordered(rules.run_rules(ctx))).collect()
    at = {r.doc_id: [(i.start, i.end) for i in r.issues if i.rule_id == "CS001"] for r in rows}
    assert at == {"wide": [(5, 15)], "narrow": [(3, 13)]}


def test_validation_names_paths():
    good = value(issue())
    assert report.validate(good) == [] == report.validate(report.serialize(good))
    assert report.validate(report.error_report("f", "ZipBombError", "x")) == []
    assert report.validate("{") [0].startswith("report: not valid JSON")
    assert report.validate([]) == ["report: expected object, got object"]
    bad = value(issue(severity="LOUD", more=1, evidence=[{"code": 1}], sourceLoc={"blockId": None, "startOffset": -1, "runIndex": 1.5, "endOffset": True}))
    bad |= {"version": 2, "meta": {"file": "f", "citations": "3", "references": 0}}
    assert report.validate(bad) == sorted([
        "report.version: expected const 1, got 2",
        'report.meta: missing required property "ruleIds"',
        "report.meta.citations: expected integer, got 3",
        'report.issues[0]: unexpected property "more"',
        'report.issues[0].severity: "LOUD" not in enum ["ERROR", "WARNING", "AMBIGUOUS", "INFO"]',
        'report.issues[0].evidence[0]: missing required property "message"',
        'report.issues[0].evidence[0]: missing required property "source"',
        "report.issues[0].evidence[0].code: expected string, got 1",
        "report.issues[0].sourceLoc.blockId: expected string, got null",
        "report.issues[0].sourceLoc.startOffset: expected >= 0, got -1",
        "report.issues[0].sourceLoc.runIndex: expected integer, got 1.5",
        "report.issues[0].sourceLoc.endOffset: expected integer, got true",
    ])


def test_renderers():
    text = report.render_text(value(issue(), issue(severity="INFO")))
    assert "Severity  Count\n--------- -----\nERROR         1\n" in text and text.endswith("2 issues found (ERROR: 1, INFO: 1)\n")
    assert report.render_text(value()).endswith("No consistency issues found.\n")
    told = report.render_detailed(value(issue(), issue(evidence=[], sourceLoc={"blockId": "b", "paragraphIndex": 3})))
    assert "1. [ERROR] CS001:0 — m\n   Source: doc-p0 (paragraph 0, chars 2-7)\n   Evidence:\n     - no-entry: e\n       (doc-p9)\n" in told
    assert told.endswith("   Source: b (paragraph 3)\n") and "2 issues found (ERROR: 2)" in told


def test_failures_and_saving(tmp_path):
    codes = {n: report.exit_code(report.error_report("f", n, "x")) for n in ("UnsupportedFormatError", "NotADocxError", "FileNotFoundError", "TimeBudgetExceededError", "Other")}
    assert codes == {"UnsupportedFormatError": 3, "NotADocxError": 2, "FileNotFoundError": 2, "TimeBudgetExceededError": 2, "Other": 2}
    assert report.save(value(issue()), str(tmp_path)) and json.loads((tmp_path / "f.docx.json").read_text())["issues"]
    assert report.save(value(), str(tmp_path), "html") and not report.save(value(), str(tmp_path / "none"))


def test_active_rules():
    own = rules.Rule("X1", "INFO", lambda c: c.blocks)
    assert rules.active_rules(["numeric"], [own]) == ["CS006", "CS007", "CS008", "CS009", "X1"] and len(rules.active_rules()) == 9
    assert rules.active_rules([]) == []


def test_stages_and_time(spark):
    b = blocks(spark, {"d": ["Doe (2017) said.", H, ENTRY.format("Doe", "J.", 2017)]})
    stages = []
    ctx, issues = lint.run(b, on_stage=stages.append, seconds=300)
    assert tuple(stages) == lint.STAGES and issues.count() == 0
    lint.release(ctx)
    slow = b.withColumn("text", F.udf(lambda t: __import__("time").sleep(20) or t)("text"))
    try:
        lint.run(slow, seconds=1.0)
    except lint.TimeBudgetExceededError as e:
        assert "budget" in str(e)
    else:
        raise AssertionError("not stopped")
    assert not spark.sparkContext.getJobTags()


def test_requests(spark):
    data = package(p("Roe (2001) said.") + p("References", "Heading1") + p("Doe, J. (2017). Citation practice. Journal of Tests, 12(3), 45-60."), {"word/styles.xml": STYLES})
    got = []
    protocol.handle(spark, protocol.request("r1", data, "a.docx"), got.append, seconds=None)
    assert [m["type"] for m in got] == ["stage"] * 5 + ["done"] and {m["id"] for m in got} == {"r1"}
    assert got[-1]["report"]["counts"]["ERROR"] == 1 and report.validate(got[-1]["report"]) == []
    got.clear()
    protocol.handle(spark, protocol.request("r2", b"no", "b.docx", ["doc-p1"]), got.append)
    assert len(got) == 1 and protocol.is_kind(got[0], "error") and got[0]["error"]["name"] == "NotADocxError"
    assert protocol.guidance_key("NotADocxError") != protocol.GENERIC == protocol.guidance_key("x") and protocol.describe("x") == "Unexpected error: x"
    assert protocol.error_of({"name": "Odd", "message": "m"}) == {"name": "Odd", "message": "m"} and protocol.error_of(ValueError("v")) == {"name": "Error", "message": "v"}
    assert "bibliographyBlockIds" not in protocol.request("r", b"", "f")


def test_run_states(spark):
    rows = [("a", 1, 1, "start", None), ("a", 2, 1, "stage", "s1"), ("a", 3, 2, "start", None), ("a", 4, 1, "done", None), ("a", 5, 2, "stage", "s1"), ("a", 6, 2, "stage", "s2")]
    rows += [("b", 1, 1, "start", None), ("b", 3, 1, "error", None), ("b", 2, 1, "stage", "s1"), ("c", 1, 3, "done", None), ("c", 2, 4, "reset", None)]
    got = {r.session: (r.generation, r.status, r.stages) for r in protocol.run_states(spark.createDataFrame(rows, "session string, seq long, generation long, kind string, stage string")).collect()}
    assert got == {"a": (2, "analyzing", ["s1", "s2"]), "b": (1, "error", ["s1"]), "c": (4, "idle", [])}


def test_resolutions(spark, tmp_path):
    new = lambda rows: spark.createDataFrame(rows, "file string, citation_id string, choice string, seq long")
    held = resolutions.upsert(spark.createDataFrame([], resolutions.HELD), new([("f", "c1", "x", 1), ("f", "c0", "y", 2), ("g", "c1", "z", 3)]))
    held = resolutions.upsert(held, new([("f", "c1", "w", 1), ("f", "c9", "v", 2), ("f", "c1", "u", 3)]))
    rows = lambda df: [(r.file, r.citation_id, r.choice, r.place) for r in df.orderBy("file", "place").collect()]
    want = [("f", "c1", "u", 0), ("f", "c0", "y", 1), ("f", "c9", "v", 2), ("g", "c1", "z", 0)]
    assert rows(held) == want and rows(resolutions.clear(held, "f")) == want[3:] and rows(resolutions.of_file(held, "f")) == want[:3] and rows(resolutions.of_file(held, None)) == []
    path = str(tmp_path / "kept")
    assert resolutions.save(held, path) and rows(resolutions.load(spark, path)) == want
    assert rows(resolutions.load(spark, str(tmp_path / "gone"))) == []
    odd = tmp_path / "odd.json"
    odd.write_text('{"f": [{"citationId": "c0", "chosenEntryId": 5}, 3, {"citationId": "c1", "chosenEntryId": "e"}], "g": "no", "h": []}\nnot json\n[1]\n')
    assert [r[:3] for r in rows(resolutions.load(spark, str(odd)))] == [("f", "c1", "e")]
    (tmp_path / "file").write_text("x")
    assert not resolutions.save(held, str(tmp_path / "file" / "below"))


def test_expected(spark):
    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    raws = metrics.expected_raws(one([("a", "x"), ("b", "y")], "fixture string, raw string"), one([("a", ["p", "p"]), ("c", [])], "fixture string, raws array<string>"))
    assert sorted(map(tuple, raws.collect())) == [("a", "p"), ("a", "p"), ("b", "y")]
    known = one([("a", "c9", "MATCHED", "e1"), ("a", "c10", "MATCHED", "e2"), ("a", "c1", "MISSING_REFERENCE", None)], "fixture string, citation_id string, relationship string, entry string")
    cites = one([("a", "c9", "x"), ("a", "c10", "x"), ("a", "c1", "y")], "fixture string, citation_id string, raw string")
    got = metrics.expected_matches(known, cites, one([("a", "z", "e7")], "fixture string, raw string, entry string"))
    assert sorted(map(tuple, got.collect())) == [("a", "x", "e2"), ("a", "z", "e7")]
    counts = metrics.expected_issue_counts(
        one([("a",), ("b",)], "fixture string"),
        one([("a", "author-date", "MISSING_REFERENCE", ["no-entry"]), ("a", "numeric", "MISSING_REFERENCE", None), ("a", "author-date", "AMBIGUOUS", ["year-mismatch"])], "fixture string, family string, relationship string, reasons array<string>"),
        one([("a", 0, "UNUSED", "doe", 2001, None), ("a", 1, "CITED", "doe", 2001, "a"), ("a", 2, "CITED", "doe", 2001, "b"), ("a", 3, "CITED", "roe", 2001, None)], "fixture string, entry int, status string, author string, year int, suffix string"),
        one([("a", "resolved", 0), ("a", "unmatched", None)], "fixture string, status string, entry int"),
        one([("b", "CS007", 2)], "fixture string, rule_id string, n int"), rules.active_rules(),
    )
    got = {(r.fixture, r.rule_id): r.expected for r in counts.collect()}
    assert len(got) == 18 and {k: n for k, n in got.items() if n} == {("a", k): 1 for k in ("CS001", "CS002", "CS003", "CS004", "CS005", "CS008")} | {("b", "CS007"): 2}


def test_quality_table():
    summary = {"detection_precision": 1.0, "detection_recall": 0.95, "matching_precision": 1.0, "false_positives": 0, "false_positive_rate": 0.0, "emitted_issues": 3, "expected_issues": 2}
    text = metrics.quality_table(summary, [{"fixture": "a", "emitted": 4, "expected": 4, "false_positives": 1, "issues": [("CS001", 2, 1), ("CS002", 0, 0)]}])
    assert "detection_recall    0.9500  (target >= 0.95)" in text and text.endswith("false  1  CS001 2/1 (+1 false)")
