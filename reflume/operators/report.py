"""Reports: a document's counts, JSON, text and HTML, validation, exit codes and saving."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reflume.functions.text import utf16_length
from reflume.operators.rules import Context, active_rules
from reflume.plans.lint import severity_counts
from reflume.schema import SEVERITIES

VERSION = 1
PROGRAM = "reflume 1.0"
#: Codes of failed runs with their exit codes; a report without issues exits with 0, others with 1.
FAILURES = {"unsupported-document": 3, "parse-failure": 2, "file-not-found": 2, "usage": 2}
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _utf16(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """issues with start and end in UTF-16 units; only texts that have characters beyond the basic plane travel."""
    wide = blocks.where(F.col("text").rlike(_ASTRAL)).groupBy("doc_id", "block_id").agg(F.first("text").alias("text"))
    wide = wide.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("block_id", "text"))).alias("_texts"))
    text = F.try_element_at(F.col("_texts"), F.col("block_id"))

    def at(name: str) -> Column:
        head = F.substring(text, F.lit(1), F.col(name))
        return F.when(text.isNull(), F.col(name)).otherwise(utf16_length(head)).alias(name)

    rest = [c for c in issues.columns if c not in ("start", "end")]
    return issues.join(wide, "doc_id", "left").select(*rest, at("start"), at("end"))


def report_rows(ctx: Context, ordered_issues: DataFrame) -> DataFrame:
    """doc_id, citations, references, the four counts, issues (array in order, offsets in UTF-16 units) of every document."""
    names = ("position", "issue_id", "rule_id", "severity", "message", "evidence", "block_id", "paragraph_index", "start", "end")
    listed = _utf16(ordered_issues, ctx.blocks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("issues"))
    cites = ctx.citations.groupBy("doc_id").agg(F.count("*").alias("citations"))
    refs = ctx.entries.groupBy("doc_id").agg(F.count("*").alias("references"))
    rows = severity_counts(ctx.documents, ordered_issues).join(cites, "doc_id", "left").join(refs, "doc_id", "left").join(listed, "doc_id", "left")
    return rows.withColumn("citations", F.coalesce("citations", F.lit(0))).withColumn("references", F.coalesce("references", F.lit(0)))


def _source(i: dict) -> dict:
    known = {"blockId": i["block_id"], "paragraphIndex": i["paragraph_index"], "startOffset": i["start"], "endOffset": i["end"]}
    return {k: v for k, v in known.items() if v is not None}


def _envelope(file: str, citations: int = 0, references: int = 0, rule_ids: Sequence[str] = (), issues: Sequence[dict] = (), counts: Mapping[str, int] | None = None) -> dict:
    meta = {"file": file, "citations": citations, "references": references, "ruleIds": list(rule_ids)}
    return {"version": VERSION, "meta": meta, "issues": list(issues), "counts": dict.fromkeys(SEVERITIES, 0) | dict(counts or {})}


def report(row: dict, name: str | None = None, rule_ids: Sequence[str] | None = None) -> dict:
    """A row of report_rows as the report's object. rule_ids: the rules that ran, all of the built-in ones by default."""
    issues = []
    for i in row["issues"] or []:
        where = _source(i)
        evidence = [{"code": e["code"], "message": e["message"], "source": where} for e in i["evidence"] or []]
        issues.append({"id": i["issue_id"], "ruleId": i["rule_id"], "severity": i["severity"], "message": i["message"], "evidence": evidence, "sourceLoc": where})
    ran = active_rules() if rule_ids is None else rule_ids
    return _envelope(name or row["doc_id"], row["citations"], row["references"], ran, issues, {s: row[s.lower()] for s in SEVERITIES})


def empty_report(name: str, rule_ids: Sequence[str] | None = None) -> dict:
    """The report of a document without blocks."""
    return _envelope(name, rule_ids=active_rules() if rule_ids is None else rule_ids)


def serialize(value: dict) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def wide(text: str) -> bool:
    """Whether a text has characters beyond the basic plane."""
    return any(c > "\uffff" for c in text)


def units(text: str) -> int:
    """The length of a text in UTF-16 units."""
    return len(text.encode("utf-16-be", "surrogatepass")) // 2


_quoted = json.encoder.encode_basestring


def _said(text: str | None) -> str:
    return "null" if text is None else _quoted(text)


def _written_source(known: Sequence[str], pad: str) -> str:
    return f"{{\n{pad}  " + f",\n{pad}  ".join(known) + f"\n{pad}}}" if known else "{}"


def written_issue(
    issue_id: str, rule: str, severity: str, message: str | None, evidence: Sequence[tuple[str, str | None]], block_id: str | None, paragraph: int | None, start: int | None, end: int | None
) -> str:
    """An issue as it stands in a serialized report; evidence is (code, message)."""
    known = [] if block_id is None else [f'"blockId": {_quoted(block_id)}']
    known += [f'"{name}": {value}' for name, value in (("paragraphIndex", paragraph), ("startOffset", start), ("endOffset", end)) if value is not None]
    there, here = _written_source(known, " " * 10), _written_source(known, " " * 6)
    told = ",\n".join(f'        {{\n          "code": {_quoted(code)},\n          "message": {_said(text)},\n          "source": {there}\n        }}' for code, text in evidence)
    told = f"[\n{told}\n      ]" if told else "[]"
    return (
        f'    {{\n      "id": {_quoted(issue_id)},\n      "ruleId": "{rule}",\n      "severity": "{severity}",\n      "message": {_said(message)},\n      "evidence": {told},\n      "sourceLoc": {here}\n    }}'
    )


def written(file: str, citations: int, references: int, rule_ids: Sequence[str], issues: Sequence[str], counts: Sequence[int]) -> str:
    """serialize(report()) of written issues and counts by severity, put together from its lines."""
    ran = ",\n".join(f"      {_quoted(r)}" for r in rule_ids)
    listed = "[\n" + ",\n".join(issues) + "\n  ]" if issues else "[]"
    told = ",\n".join(f'    "{s}": {n}' for s, n in zip(SEVERITIES, counts, strict=True))
    return (
        f'{{\n  "version": {VERSION},\n  "meta": {{\n    "file": {_said(file)},\n    "citations": {citations},\n    "references": {references},\n    "ruleIds": [\n{ran}\n    ]\n  }},\n'
        f'  "issues": {listed},\n  "counts": {{\n{told}\n  }}\n}}\n'
    )


def report_json(rows: DataFrame, rule_ids: Sequence[str] | None = None) -> DataFrame:
    """doc_id, json of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.to_pylist()
            texts = [serialize(report(r, rule_ids=rule_ids)) for r in out]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in out], pa.string()), pa.array(texts, pa.string())], ["doc_id", "json"])

    return rows.mapInArrow(run, "doc_id string, json string")


# --- Failures ------------------------------------------------------------------------------------


def failure(name: str, message: str) -> dict:
    """code and message of an error by its name."""
    if name == "UnsupportedFormatError":
        return {"code": "unsupported-document", "message": message}
    if name == "FileNotFoundError":
        return {"code": "file-not-found", "message": f"file not found: {message}"}
    if name in ("PermissionError", "IsADirectoryError", "NotADirectoryError"):
        return {"code": "file-not-found", "message": message}
    return {"code": "parse-failure", "message": message}


def error_report(file: str, name: str, message: str) -> dict:
    return _envelope(file) | {"error": failure(name, message)}


def exit_code(value: dict) -> int:
    """0 no issue, 1 any issue, else that of the failure."""
    return FAILURES[value["error"]["code"]] if "error" in value else int(bool(value["issues"]))


# --- Validation ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Text:
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class _Whole:
    least: int | None = 0
    exactly: int | None = None


@dataclass(frozen=True)
class _Many:
    of: object


@dataclass(frozen=True)
class _Record:
    """fields by name; those not in `optional` are required, and no others are allowed."""

    fields: dict[str, object]
    optional: frozenset[str] = field(default_factory=frozenset)


_PLACE = _Record(
    {"blockId": _Text(), "paragraphIndex": _Whole(), "runIndex": _Whole(), "startOffset": _Whole(), "endOffset": _Whole()},
    frozenset({"paragraphIndex", "runIndex", "startOffset", "endOffset"}),
)
_EVIDENCE = _Record({"code": _Text(), "message": _Text(), "source": _PLACE})
_ISSUE = _Record({"id": _Text(), "ruleId": _Text(), "severity": _Text(SEVERITIES), "message": _Text(), "evidence": _Many(_EVIDENCE), "sourceLoc": _PLACE})
_REPORT = _Record(
    {
        "version": _Whole(None, VERSION),
        "meta": _Record({"file": _Text(), "citations": _Whole(), "references": _Whole(), "ruleIds": _Many(_Text())}),
        "issues": _Many(_ISSUE),
        "counts": _Record({s: _Whole() for s in SEVERITIES}),
        "error": _Record({"code": _Text(tuple(FAILURES)), "message": _Text()}),
    },
    frozenset({"error"}),
)


def _shown(value) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return "object" if isinstance(value, dict | list) else str(value)


def _faults(kind: object, value, path: str) -> Iterator[str]:
    """What is wrong with a value, from the outside in."""
    whole = type(value) is int or (type(value) is float and value.is_integer())
    match kind:
        case _Record(fields, optional):
            if not isinstance(value, dict):
                yield f"{path}: expected object, got {_shown(value)}"
                return
            yield from (f'{path}: missing required property "{k}"' for k in fields if k not in value and k not in optional)
            yield from (f'{path}: unexpected property "{k}"' for k in value if k not in fields)
            for k in fields.keys() & value.keys():
                yield from _faults(fields[k], value[k], f"{path}.{k}")
        case _Many(of):
            if not isinstance(value, list):
                yield f"{path}: expected array, got {_shown(value)}"
                return
            for n, x in enumerate(value):
                yield from _faults(of, x, f"{path}[{n}]")
        case _Text(options):
            if not isinstance(value, str):
                yield f"{path}: expected string, got {_shown(value)}"
            elif options and value not in options:
                yield f'{path}: "{value}" not in enum [{", ".join(json.dumps(o) for o in options)}]'
        case _Whole(least, exactly):
            if not whole:
                yield f"{path}: expected integer, got {_shown(value)}"
            elif exactly is not None and value != exactly:
                yield f"{path}: expected const {exactly}, got {_shown(value)}"
            elif least is not None and value < least:
                yield f"{path}: expected >= {least}, got {_shown(value)}"


def validate(value) -> list[str]:
    """What is wrong with a report (its JSON text or its object), by path; nothing if it is well formed."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError as e:
            return [f"report: not valid JSON — {e}"]
    return sorted(_faults(_REPORT, value, "report"))


# --- Rendering -------------------------------------------------------------------------------------


def _head(value: dict) -> list[str]:
    meta = value["meta"]
    return [f"{PROGRAM} — {meta['file']}", f"Citations: {meta['citations']}    References: {meta['references']}", ""]


def _summary(value: dict) -> str:
    n = len(value["issues"])
    if not n:
        return "No consistency issues found."
    shares = ", ".join(f"{s}: {value['counts'][s]}" for s in SEVERITIES if value["counts"][s])
    return f"{n} {'issue' if n == 1 else 'issues'} found ({shares})"


def _place(at: dict) -> str:
    """A block, with its paragraph, with its characters, as far as they are known."""
    inside = []
    if "paragraphIndex" in at:
        inside.append(f"paragraph {at['paragraphIndex']}")
        if {"startOffset", "endOffset"} <= at.keys():
            inside.append(f"chars {at['startOffset']}-{at['endOffset']}")
    return f"{at['blockId']} ({', '.join(inside)})" if inside else at["blockId"]


def render_text(value: dict) -> str:
    """How many issues there are of each severity."""
    table = [("Severity", "Count"), ("-" * 9, "-" * 5), *((s, str(value["counts"][s])) for s in SEVERITIES)]
    return "\n".join([*_head(value), *(f"{a:<9} {b:>5}" for a, b in table), "", _summary(value)]) + "\n"


def render_detailed(value: dict) -> str:
    """All issues with where they are and what speaks for them."""
    lines = [*_head(value), _summary(value)]
    for n, issue in enumerate(value["issues"], 1):
        here = issue["sourceLoc"]
        lines += ["", f"{n}. [{issue['severity']}] {issue['id']} — {issue['message']}", f"   Source: {_place(here)}"]
        if issue["evidence"]:
            lines.append("   Evidence:")
        for e in issue["evidence"]:
            lines.append(f"     - {e['code']}: {e['message']}")
            if e["source"]["blockId"] != here["blockId"]:
                lines.append(f"       ({_place(e['source'])})")
    return "\n".join(lines) + "\n"


def render_html(value: dict) -> str:
    """One page; the report itself is embedded so that no text in it can end the script."""
    rows = "".join(f"<tr><td>{html.escape(i['severity'])}</td><td>{html.escape(i['ruleId'])}</td><td>{html.escape(i['message'])}</td></tr>" for i in value["issues"])
    data = json.dumps(value, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    title = html.escape(str(value["meta"]["file"]))
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><table>{rows}</table><script type="application/json">{data}</script></body></html>'


# --- Saving ------------------------------------------------------------------------------------------


def file_name(file: str, kind: str) -> str:
    """What a report of a file is saved as; kind json or html."""
    return f"{file}.{kind}"


def saved(save: Callable[[], object]) -> bool:
    """Whether save() went without an error."""
    try:
        save()
    except Exception:  # whatever hinders a save, the report itself is not lost
        return False
    return True


def save(value: dict, folder: str, kind: str = "json") -> bool:
    """Writes a report beside others in a folder of the driver's; False where that is not possible."""
    text = serialize(value) if kind == "json" else render_html(value)
    name = file_name(Path(value["meta"]["file"]).name, kind)
    return saved(lambda: Path(folder, name).write_text(text, encoding="utf-8"))
