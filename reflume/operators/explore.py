"""Questions about a finished analysis, and decisions made by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reflume.operators.rules import Context, severity_rank


def issues_by_severity(issues: DataFrame) -> DataFrame:
    """doc_id, severity, rank, issue_ids in order; severities without issues are left out."""
    rows = issues.groupBy("doc_id", "severity").agg(F.array_sort(F.collect_list(F.struct("position", "issue_id"))).alias("x"))
    return rows.select("doc_id", "severity", severity_rank(F.col("severity")).alias("rank"), F.transform("x", lambda i: i["issue_id"]).alias("issue_ids"))


def highlights(ctx: Context, issues: DataFrame) -> DataFrame:
    """doc_id, issue_id, before, mark, after of the block of each issue; offsets are cut to the text, no block gives nulls."""
    rows = issues.select("doc_id", "issue_id", "block_id", "start", "end").join(ctx.blocks.select("doc_id", "block_id", "text"), ["doc_id", "block_id"], "left")
    n = F.length("text")
    clamp = lambda c, other: F.least(F.greatest(F.when(c < 0, n + c).otherwise(F.coalesce(c, other)), F.lit(0)), n)
    a, b = clamp(F.col("start"), F.lit(0)), clamp(F.col("end"), n)
    return rows.select("doc_id", "issue_id", F.substring("text", F.lit(1), a).alias("before"), F.substring("text", a + 1, F.greatest(b - a, F.lit(0))).alias("mark"), F.substring("text", b + 1, n).alias("after"))


def reference_labels(entries: DataFrame) -> DataFrame:
    """doc_id, entry_index, label: authors, year and title, or what there is of them."""
    names = F.array_join(F.transform(F.coalesce("authors", F.array()), lambda a: a["original"]), ", ")
    head = F.concat_ws(" ", F.when(names != "", names), F.concat(F.lit("("), F.col("year").cast("string"), F.coalesce("year_suffix", F.lit("")), F.lit(")")))
    return entries.select("doc_id", "entry_index", F.concat_ws(" — ", F.when(head != "", head), F.coalesce("title", "raw")).alias("label"))


def possible_references(ctx: Context, issues: DataFrame) -> DataFrame:
    """doc_id, issue_id, entry_indexes: the match of the citation at the issue's place, else its numbers; for entries the entry itself."""
    place = ["doc_id", "block_id", "start", "end"]
    keyed = issues.select("issue_id", *place)
    cites = ctx.citations.select("doc_id", "ord", "block_id", "start", "end").join(ctx.matches, ["doc_id", "ord"])
    first = cites.withColumn("k", F.row_number().over(Window.partitionBy(*place).orderBy("ord"))).where("k = 1")
    dated = keyed.join(first, place).select("doc_id", "issue_id", F.lit(0).alias("way"), F.posexplode(F.array_compact(F.concat(F.array("entry_index"), "candidates"))).alias("o", "entry_index"))
    numbered = keyed.join(ctx.tokens.where("status = 'resolved'").select(*place, "entry_index"), place).select("doc_id", "issue_id", F.lit(1).alias("way"), F.col("entry_index").alias("o"), "entry_index")
    own = keyed.join(ctx.entries.select("doc_id", "block_id", "entry_index"), ["doc_id", "block_id"]).select("doc_id", "issue_id", F.lit(2).alias("way"), F.lit(0).alias("o"), "entry_index")
    rows = dated.unionByName(numbered).unionByName(own).groupBy("doc_id", "issue_id").agg(F.array_sort(F.collect_set(F.struct("way", "o", "entry_index"))).alias("x"))
    return rows.select("doc_id", "issue_id", F.array_distinct(F.transform("x", lambda r: r["entry_index"])).alias("entry_indexes"))


def resolution_candidates(ctx: Context) -> DataFrame:
    """doc_id, citation_id, candidates of ambiguous citations."""
    return ctx.matches.where("relationship = 'AMBIGUOUS' and size(candidates) > 0").select("doc_id", "citation_id", "candidates")


def latest_resolutions(events: DataFrame) -> DataFrame:
    """file, citation_id, choice from events (file, seq, action set/resolve/clear, citation_id, choice): the last choice after the file's last clear."""
    w = Window.partitionBy("file")
    rows = events.withColumn("cleared", F.max(F.when(F.col("action") == "clear", F.col("seq"))).over(w)).where("action = 'resolve' and (cleared is null or seq > cleared)")
    return rows.groupBy("file", "citation_id").agg(F.max_by("choice", "seq").alias("choice")).where("choice is not null")


def chosen(candidates: DataFrame, resolutions: DataFrame) -> DataFrame:
    """doc_id, citation_id, choice of resolutions (file, citation_id, choice) that are among the candidates of their citation (doc_id, citation_id, candidates)."""
    valid = candidates.join(resolutions.withColumnRenamed("file", "doc_id"), ["doc_id", "citation_id"]).where(F.array_contains("candidates", F.col("choice")))
    return valid.select("doc_id", "citation_id", "choice")


def apply_resolutions(ctx: Context, issues: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved citations: doc_id, citation_id, choice; doc_id, severity, resolved). Choices that are no candidate are passed over; the issues stay as they are."""
    decided = chosen(resolution_candidates(ctx), resolutions)
    at = ctx.citations.select("doc_id", "citation_id", "block_id", "start", "end").join(decided, ["doc_id", "citation_id"])
    counts = issues.join(at.select("doc_id", "block_id", "start", "end"), ["doc_id", "block_id", "start", "end"], "left_semi").groupBy("doc_id", "severity").agg(F.count("*").alias("resolved"))
    return decided, counts


def stage_status(runs: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """run_id, stage, status (done, current, pending) from runs (run_id, current)."""
    order = F.array(*map(F.lit, stages))
    rows = runs.select("run_id", F.array_position(order, F.col("current")).alias("now"), F.posexplode(order).alias("k", "stage"))
    return rows.select("run_id", "stage", F.when(F.col("k") + 1 < F.col("now"), "done").when(F.col("k") + 1 == F.col("now"), "current").otherwise("pending").alias("status"))
