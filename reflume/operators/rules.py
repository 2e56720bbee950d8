"""Consistency rules: each is a function from the analysis to a table of issues."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reflume.functions.text import trim, truncate
from reflume.schema import SEVERITIES

#: What each reason says.
REASONS = {
    "exact": "First author matched on the exact normalized key.",
    "normalized": "First author matched on the normalized key.",
    "diacritic-insensitive": "First author matched only on the diacritic-stripped key.",
    "initials": "First author matched only on the initial-compatible tier.",
    "fuzzy": "First author matched only on the fuzzy tier.",
    "given-initial-mismatch": "First-author given initials contradict the reference entry.",
    "year-match": "Citation year equals the reference entry year.",
    "year-mismatch": "Citation year differs from the reference entry year.",
    "no-year": "Citation or reference entry lacks a year.",
    "year-suffix": "Same-year disambiguation suffix present on one side.",
    "author-mismatch": "No author tier matched the reference entry.",
    "page-match": "Cited page found in the reference entry pages.",
    "additional-authors": "Additional cited authors matched reference entry authors.",
    "no-entry": "No bibliography entry exists to match this citation.",
    "ambiguous": "Multiple reference entries match this citation; none was auto-selected.",
}
INVALID = {
    "malformed": 'the bracket contains a malformed numeric token (e.g. "1a", "1 2", a reversed or oversized range)',
    "mixed": 'the bracket mixes numeric indices with non-numeric text (e.g. "[1, x]")',
}
SEGMENTS = {"author-date": ("CS001", "CS002", "CS003", "CS004", "CS005"), "numeric": ("CS006", "CS007", "CS008", "CS009")}
ISSUE = ("doc_id", "rule_id", "n", "severity", "message", "evidence", "block_id", "block_ord", "paragraph_index", "start", "end")


@dataclass
class Context:
    """All tables of one analysis. matches, status and tokens are None where no matching was done."""

    blocks: DataFrame
    documents: DataFrame
    citations: DataFrame
    invalid: DataFrame
    entries: DataFrame
    matches: DataFrame | None
    status: DataFrame | None
    tokens: DataFrame | None
    held: list[DataFrame] = field(default_factory=list)  # kept in memory or on disk until they are released


def _issues(df: DataFrame, rule: str, severity: str, message: Column, evidence: Column, order: Sequence[str]) -> DataFrame:
    """Numbers issues by `order` within each document."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    return df.select(
        "doc_id", F.lit(rule).alias("rule_id"), (F.row_number().over(w) - 1).alias("n"), F.lit(severity).alias("severity"), message.alias("message"), evidence.alias("evidence"),
        "block_id", "block_ord", "paragraph_index", "start", "end",
    )


def _say(code: Column | str, text: Column) -> Column:
    return F.array(F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), text.alias("message")))


def _by_reason() -> Column:
    told = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    return F.transform(F.array_distinct("reasons"), lambda r: F.struct(r.alias("code"), F.try_element_at(told, r).alias("message")))


def _dated(ctx: Context) -> DataFrame:
    rows = ctx.citations.where("family = 'author-date'").select("doc_id", "ord", "citation_id", "raw", "items", "block_id", "block_ord", "paragraph_index", "start", "end")
    rows = rows.join(ctx.matches.select("doc_id", "ord", "relationship", "reasons"), ["doc_id", "ord"])
    return rows.withColumn("label", F.when(trim(F.col("raw")) == "", F.col("citation_id")).otherwise(truncate(trim(F.col("raw")))))


def _of_entries(entries: DataFrame) -> DataFrame:
    return entries.withColumn("start", F.lit(0)).withColumn("end", F.length("raw"))


def cs001(ctx: Context) -> DataFrame | None:
    if ctx.matches is None:
        return None
    rows = _dated(ctx).where("relationship = 'MISSING_REFERENCE'")
    return _issues(rows, "CS001", "ERROR", F.concat(F.lit("Missing reference: no bibliography entry matches '"), "label", F.lit("'.")), _by_reason(), ["ord"])


def cs002(ctx: Context) -> DataFrame | None:
    if ctx.status is None:
        return None
    rows = _of_entries(ctx.entries).join(ctx.status.where("status = 'UNUSED'").select("doc_id", "entry_index"), ["doc_id", "entry_index"], "left_semi")
    message = F.concat(F.lit("Unused reference: bibliography entry '"), truncate(F.col("raw")), F.lit("' is never cited."))
    return _issues(rows, "CS002", "WARNING", message, _say("unused", F.lit("Bibliography entry is never cited by any citation.")), ["entry_index"])


def cs003(ctx: Context) -> DataFrame | None:
    if ctx.matches is None:
        return None
    rows = _dated(ctx).where(F.array_contains("reasons", "year-mismatch"))
    year = F.get(F.filter(F.transform("items", lambda i: i["year"]), lambda y: y.isNotNull()), F.lit(0))
    message = F.concat(F.lit("Possible year mismatch: citation '"), "label", F.lit("' year "), F.coalesce(F.concat(F.lit("("), year.cast("string"), F.lit(") ")), F.lit("")), F.lit("does not match the reference entry year."))
    return _issues(rows, "CS003", "WARNING", message, _by_reason(), ["ord"])


def cs004(ctx: Context) -> DataFrame | None:
    if ctx.matches is None:
        return None
    rows = _dated(ctx).where("relationship = 'AMBIGUOUS'")
    message = F.concat(F.lit("Ambiguous author-date match: '"), "label", F.lit("' matches multiple reference entries; no single entry was selected (never auto-picked)."))
    return _issues(rows, "CS004", "AMBIGUOUS", message, _by_reason(), ["ord"])


def cs005(ctx: Context) -> DataFrame:
    rows = _of_entries(ctx.entries).withColumn("first", F.get(F.coalesce("authors", F.array()), F.lit(0))["exact"]).where("first is not null and year is not null").withColumn("suffix", F.coalesce("year_suffix", F.lit("")))
    cluster = Window.partitionBy("doc_id", "first", "year")
    rows = rows.withColumn("m", F.count("*").over(cluster)).withColumn("head", F.min("entry_index").over(cluster)).withColumn("same", F.count("*").over(Window.partitionBy("doc_id", "first", "year", "suffix")))
    rows = rows.where("m >= 2 and (suffix = '' or same >= 2)")
    y = F.col("year").cast("string")
    message = F.concat(F.lit("Same author and year as another reference entry: '"), truncate(F.col("raw")), F.lit("' needs a year suffix (e.g. "), y, F.lit("a / "), y, F.lit("b) to disambiguate."))
    return _issues(rows, "CS005", "WARNING", message, _say("missing-suffix", F.lit("Same-author-same-year entries lack a unique disambiguation suffix (2018a / 2018b).")), ["head", "entry_index"])


def cs006(ctx: Context) -> DataFrame:
    rows = _of_entries(ctx.entries).where("failure is not null")
    message = F.concat(F.lit("Unparseable reference entry "), (F.col("entry_index") + 1).cast("string"), F.lit(": '"), truncate(F.col("raw")), F.lit("' — "), "failure", F.lit("."))
    return _issues(rows, "CS006", "ERROR", message, _say("reference-parse", F.col("failure")), ["entry_index"])


def cs007(ctx: Context) -> DataFrame:
    why = F.when(F.col("reason") == "mixed", INVALID["mixed"]).otherwise(INVALID["malformed"])
    message = F.concat(F.lit("Invalid numeric citation '"), truncate(F.col("raw"), 40), F.lit("': "), why, F.lit("."))
    return _issues(ctx.invalid, "CS007", "WARNING", message, _say("invalid-numeric", why), ["block_ord", "nth"])


def cs008(ctx: Context) -> DataFrame | None:
    if ctx.tokens is None:
        return None
    index, n = F.col("index").cast("string"), F.col("n").cast("string")
    message = F.when(F.col("status") == "out-of-range", F.concat(F.lit("Missing numeric reference: index "), index, F.lit(" is out of range (the bibliography has "), n, F.when(F.col("n") == 1, " entry).").otherwise(" entries)."))).otherwise(
        F.concat(F.lit("Missing numeric reference: index "), index, F.lit(" is not a valid 1-based reference position."))
    )
    return _issues(ctx.tokens.where("status <> 'resolved'"), "CS008", "ERROR", message, _say(F.col("status"), message), ["ord", "tok_ord"])


def cs009(ctx: Context) -> DataFrame | None:
    if ctx.tokens is None:
        return None
    rows = _of_entries(ctx.entries).join(ctx.citations.where("family = 'numeric'").select("doc_id").distinct(), "doc_id", "left_semi")
    rows = rows.join(ctx.tokens.where("status = 'resolved'").select("doc_id", "entry_index"), ["doc_id", "entry_index"], "left_anti")
    if ctx.status is not None:
        rows = rows.join(ctx.status.where("status <> 'UNUSED'").select("doc_id", "entry_index"), ["doc_id", "entry_index"], "left_anti")
    message = F.concat(F.lit("Unused numeric reference: bibliography entry '"), truncate(F.col("raw")), F.lit("' is never cited by any numeric citation."))
    return _issues(rows, "CS009", "WARNING", message, _say("unused", F.lit("Bibliography entry is never cited by any numeric citation.")), ["entry_index"])


RULES: dict[str, Callable[[Context], DataFrame | None]] = {f.__name__.upper(): f for f in (cs001, cs002, cs003, cs004, cs005, cs006, cs007, cs008, cs009)}
#: The severity that each has where none is chosen.
SEVERITY = {"CS001": "ERROR", "CS002": "WARNING", "CS003": "WARNING", "CS004": "AMBIGUOUS", "CS005": "WARNING", "CS006": "ERROR", "CS007": "WARNING", "CS008": "ERROR", "CS009": "WARNING"}


def _good(overrides: Mapping[str, str] | None) -> dict[str, str]:
    """The overrides that name a severity, in any case."""
    return {k: v.upper() for k, v in (overrides or {}).items() if isinstance(v, str) and v.upper() in SEVERITIES}


def severities(overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """The severity of each rule under overrides, which are those of run_rules."""
    return SEVERITY | _good(overrides)


@dataclass(frozen=True)
class Rule:
    """A rule of one's own: run gives issues (doc_id, message, block_id and, if wanted, severity, evidence, start, end)."""

    id: str
    severity: str
    run: Callable[[Context], DataFrame]

    def __post_init__(self) -> None:
        if not isinstance(self.id, str) or not self.id or not callable(self.run):
            raise TypeError("a rule has an id and a function")
        if self.severity not in SEVERITIES:
            raise TypeError(f"{self.id}: severity {self.severity!r} is not one of {', '.join(SEVERITIES)}")


def _own(rule: Rule, ctx: Context) -> DataFrame:
    rows = rule.run(ctx)
    lacks = {"doc_id", "message", "block_id"} - set(rows.columns)
    if lacks:
        raise TypeError(f"{rule.id}: no column {', '.join(sorted(lacks))}")
    have = set(rows.columns)
    rows = rows.select(
        "doc_id", F.lit(rule.id).alias("rule_id"), (F.col("severity") if "severity" in have else F.lit(rule.severity)).alias("severity"), "message",
        (F.col("evidence") if "evidence" in have else F.array().cast("array<struct<code:string,message:string>>")).alias("evidence"), "block_id",
        (F.col("start") if "start" in have else F.lit(None)).cast("int").alias("start"), (F.col("end") if "end" in have else F.lit(None)).cast("int").alias("end"),
    )
    rows = rows.join(ctx.blocks.select("doc_id", "block_id", "block_ord", "paragraph_index"), ["doc_id", "block_id"], "left")
    w = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("block_ord"), "start", "end", "message")
    return rows.withColumn("n", F.row_number().over(w) - 1).select(*ISSUE)


def active_rules(enabled: Sequence[str] | None = None, custom: Sequence[Rule] = ()) -> list[str]:
    """Ids of the rules that a run with these options has, built-in ones first."""
    return [i for segment, ids in SEGMENTS.items() if enabled is None or segment in enabled for i in ids] + [r.id for r in custom]


def run_rules(ctx: Context, enabled: Sequence[str] | None = None, overrides: Mapping[str, str] | None = None, custom: Sequence[Rule] = ()) -> DataFrame:
    """All issues. enabled: segments to run (all); overrides: rule id -> severity in any case, others are passed over."""
    ids = [r.id for r in custom]
    clash = [i for i in ids if i in RULES or ids.count(i) > 1]
    if clash:
        raise TypeError(f"rule id used twice: {clash[0]}")
    parts = [p for i in active_rules(enabled) if (p := RULES[i](ctx)) is not None] + [_own(r, ctx) for r in custom]
    if not parts:
        parts = [cs007(ctx).limit(0)]
    out = parts[0].select(*ISSUE)
    for p in parts[1:]:
        out = out.unionByName(p.select(*ISSUE))
    good = _good(overrides)
    if good:
        new = F.create_map(*(F.lit(x) for pair in good.items() for x in pair))
        out = out.withColumn("severity", F.coalesce(F.try_element_at(new, F.col("rule_id")), F.col("severity")))
    return out.withColumn("issue_id", issue_id())


def issue_id() -> Column:
    return F.concat_ws(":", "rule_id", F.col("n").cast("string"))


def severity_rank(c: Column) -> Column:
    rank = F.when(c == SEVERITIES[0], 0)
    for k, s in enumerate(SEVERITIES[1:], 1):
        rank = rank.when(c == s, k)
    return rank


def ordered(issues: DataFrame) -> DataFrame:
    """issues with `position`: by severity, place in the document, rule and id."""
    w = Window.partitionBy("doc_id").orderBy(
        severity_rank(F.col("severity")), F.asc_nulls_last("block_ord"), F.coalesce("paragraph_index", F.lit(0)), F.coalesce("start", F.lit(0)), F.coalesce("end", F.lit(0)), "block_id", "rule_id", "issue_id"
    )
    return issues.withColumn("position", F.row_number().over(w) - 1)
