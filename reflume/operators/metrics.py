"""Quality and timing metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TARGETS = {"detection_precision": 0.98, "detection_recall": 0.95, "matching_precision": 0.97}


def multiset_overlap(emitted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, emitted, expected, true_positive, false_positive of each distinct key."""
    a, b = emitted.groupBy(*keys).agg(F.count("*").alias("emitted")), expected.groupBy(*keys).agg(F.count("*").alias("expected"))
    rows = a.join(b, keys, "full_outer").select(*keys, F.coalesce("emitted", F.lit(0)).alias("emitted"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return rows.withColumn("true_positive", F.least("emitted", "expected")).withColumn("false_positive", F.greatest(F.lit(0), F.col("emitted") - F.col("expected")))


def precision_recall(overlap: DataFrame) -> DataFrame:
    """precision, recall, false_positives; an empty side counts as 1."""
    share = lambda tp, n: F.coalesce(F.sum(tp) / F.nullif(F.sum(n), F.lit(0)), F.lit(1.0))
    return overlap.agg(share("true_positive", "emitted").alias("precision"), share("true_positive", "expected").alias("recall"), F.coalesce(F.sum("false_positive"), F.lit(0)).alias("false_positives"))


def expected_raws(occurrences: DataFrame, overlays: DataFrame) -> DataFrame:
    """fixture, raw of all citations that should be found: those of overlays (fixture, raws) in place of all others (fixture, raw) of their fixtures."""
    others = occurrences.join(overlays.select("fixture").distinct(), "fixture", "left_anti").select("fixture", "raw")
    return others.unionByName(overlays.select("fixture", F.explode("raws").alias("raw")))


def expected_matches(matches: DataFrame, occurrences: DataFrame, overlays: DataFrame) -> DataFrame:
    """fixture, raw, entry that should be matched.

    matches (fixture, citation_id, relationship, entry) go by the text of their
    citations (fixture, citation_id, raw), of several the last by id's length
    and id; overlays (fixture, raw, entry) come before them.
    """
    known = matches.where("relationship = 'MATCHED' and entry is not null").join(occurrences.select("fixture", "citation_id", "raw"), ["fixture", "citation_id"])
    by_raw = known.groupBy("fixture", "raw").agg(F.max_by("entry", F.struct(F.length("citation_id"), "citation_id")).alias("found"))
    over = overlays.select("fixture", "raw", F.col("entry").alias("told"))
    return by_raw.join(over, ["fixture", "raw"], "full_outer").select("fixture", "raw", F.coalesce("told", "found").alias("entry"))


def expected_issue_counts(fixtures: DataFrame, citations: DataFrame, entries: DataFrame, tokens: DataFrame, overlays: DataFrame, rules: Sequence[str]) -> DataFrame:
    """fixture, rule_id, expected: how many issues of each rule the truth calls for, zeros kept.

    citations: fixture, family, relationship, reasons. entries: fixture, entry,
    status, author (the first one's key), year, suffix. tokens: fixture, status,
    entry. overlays: fixture, rule_id, n, added to what follows from the others.
    """
    dated = F.col("family") == "author-date"
    of_citations = citations.select("fixture", F.explode(F.array_compact(F.array(
        F.when((F.col("relationship") == "MISSING_REFERENCE") & dated, F.lit("CS001")), F.when(F.array_contains("reasons", "year-mismatch"), F.lit("CS003")),
        F.when(F.col("relationship") == "AMBIGUOUS", F.lit("CS004")),
    ))).alias("rule_id"))
    cluster, mark = Window.partitionBy("fixture", "author", "year"), F.coalesce("suffix", F.lit(""))
    alike = F.count("*").over(cluster) >= 2
    same_mark = F.count("*").over(Window.partitionBy("fixture", "author", "year", mark)) >= 2
    alone = entries.where("author is not null and year is not null").select("fixture", (alike & ((mark == "") | same_mark)).alias("bare")).where("bare").select("fixture", F.lit("CS005").alias("rule_id"))
    unused = entries.where("status = 'UNUSED'").select("fixture", F.lit("CS002").alias("rule_id"))
    bound = tokens.where("entry is not null").select("fixture", "entry").distinct()
    idle = entries.where("status is null or status not in ('CITED', 'AMBIGUOUS_USAGE')").join(bound, ["fixture", "entry"], "left_anti").select("fixture", F.lit("CS009").alias("rule_id"))
    loose = tokens.where("status <> 'resolved'").select("fixture", F.lit("CS008").alias("rule_id"))
    ones = of_citations.unionByName(alone).unionByName(unused).unionByName(idle).unionByName(loose).withColumn("n", F.lit(1))
    counts = ones.unionByName(overlays.select("fixture", "rule_id", F.col("n").cast("int"))).groupBy("fixture", "rule_id").agg(F.sum("n").alias("n"))
    frame = fixtures.select("fixture").distinct().select("fixture", F.explode(F.array(*map(F.lit, rules))).alias("rule_id"))
    return frame.join(counts, ["fixture", "rule_id"], "left").select("fixture", "rule_id", F.coalesce("n", F.lit(0)).alias("expected"))


def quality_table(summary: Mapping[str, float], fixtures: Sequence[Mapping]) -> str:
    """The metrics as text.

    summary: detection_precision, detection_recall, matching_precision,
    false_positives, false_positive_rate, emitted_issues, expected_issues.
    fixtures: rows with fixture, emitted, expected, false_positives and issues,
    a list of (rule, emitted, expected); rules that agree are not shown.
    """
    lines = [f"quality metrics: {len(fixtures)} fixtures"]
    for name, target in TARGETS.items():
        lines.append(f"  {name:<20}{summary[name]:.4f}  (target >= {target})")
    lines.append(f"  {'false_positives':<20}{summary['false_positives']}  (target 0)")
    lines.append(f"  {'false_positive_rate':<20}{summary['false_positive_rate']:.4f}")
    lines += [f"  {name:<20}{summary[name]}" for name in ("emitted_issues", "expected_issues")]
    lines.append("by fixture (citations emitted and expected, issues that are false):")
    for row in fixtures:
        off = [f"{rule} {got}/{want}" + (f" (+{got - want} false)" if got > want else "") for rule, got, want in row["issues"] if got != want]
        lines.append("  ".join([f"  {row['fixture']:<42}emitted {row['emitted']:>3}", f"expected {row['expected']:>3}", f"false {row['false_positives']:>2}", *off]))
    return "\n".join(lines)


def gates(measured: DataFrame) -> DataFrame:
    """metric, value, target, passed from measured (metric, value)."""
    target = F.create_map(*(F.lit(x) for pair in TARGETS.items() for x in pair))
    return measured.withColumn("target", F.try_element_at(target, F.col("metric"))).withColumn("passed", F.col("value") >= F.col("target"))


def timing(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """median, nearest-rank p95, min, max and spread in percent of the median."""
    out = samples.groupBy(*by).agg(F.median(value).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.withColumn("spread", (F.col("max") - F.col("min")) / F.col("median") * 100)


def stage_elapsed(events: DataFrame, run: str, at: str) -> DataFrame:
    """events with `elapsed`: seconds to the next event of the run."""
    nxt = F.lead(at).over(Window.partitionBy(run).orderBy(at, "event_id"))
    return events.withColumn("elapsed", F.unix_micros(nxt.cast("timestamp")) / 1e6 - F.unix_micros(F.col(at).cast("timestamp")) / 1e6)
