"""Matching citations to entries: scored join, best two, combination, entry status, number binding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, POSSIBLE, MARGIN = 0.7, 0.4, 0.1
CREDIT = {1: 1.0, 3: 0.8, 4: 0.6, 5: 0.0}


@dataclass(frozen=True)
class Weights:
    first_author: float = 0.40
    year: float = 0.35
    additional_authors: float = 0.15
    year_suffix: float = 0.05
    other: float = 0.05


def items(citations: DataFrame) -> DataFrame:
    """One row an author-date item: doc_id, ord, item_ord, item, key."""
    rows = citations.where("family = 'author-date'").select("doc_id", "ord", F.posexplode(F.arrays_zip("items", "keys")).alias("item_ord", "z"))
    return rows.select("doc_id", "ord", "item_ord", F.col("z.items").alias("item"), F.col("z.keys").alias("key"))


def targets(entries: DataFrame) -> DataFrame:
    """What matching needs of entries: doc_id, entry_index and a struct e."""
    first = F.get("authors", F.lit(0))
    token = lambda c: F.get(F.split(c, " "), F.lit(0))
    others = F.transform(F.slice("authors", F.lit(2), F.greatest(F.size("authors") - 1, F.lit(0))), lambda a: F.struct(token(a["exact"]).alias("exact"), token(a["bare"]).alias("bare")))
    authors = F.when(F.size("authors") > 0, F.col("authors"))
    return entries.withColumn("authors", authors).select(
        "doc_id", "entry_index",
        F.struct(
            first.isNotNull().alias("named"), token(first["exact"]).alias("exact"), token(first["bare"]).alias("bare"), first["initials"].alias("initials"), first["given"].isNotNull().alias("given"),
            F.when(authors.isNotNull(), others).otherwise(F.array().cast("array<struct<exact:string,bare:string>>")).alias("others"), "year", F.col("year_suffix").alias("suffix"), "pages",
        ).alias("e"),
    )


#: What a pair is told by besides its tier, in the order of reasons; the k-th is bit k + 3 of a pair's code.
_TRAITS = ("given-initial-mismatch", "no-year", "clash", "year-mismatch", "year-match", "suffix", "additional-authors", "page-match")
_TIERS = {1: "exact", 3: "diacritic-insensitive", 4: "initials", 5: "author-mismatch"}
_CODE_BITS, _INDEX_BITS, _POINTS = 3 + len(_TRAITS), 31, 10_000


def _compare(w: Weights) -> tuple[Column, Column]:
    """(points, code) of a joined row with item, key and e: the score in whole 1/10,000, and tier and traits in 11 bits."""
    k, e, item = F.col("key"), F.col("e"), F.col("item")
    tier = (
        F.when(~e["named"] | (k["exact"] == ""), 5).when(k["exact"] == e["exact"], 1).when(k["bare"] == e["bare"], 3)
        .when((k["initials"] != "") & F.startswith(e["initials"], k["initials"]), 4).otherwise(5)
    )
    g, i = k["given"], e["initials"]
    conflict = e["named"] & e["given"] & (F.length(g) >= 2) & (F.length(i) >= 2) & (F.substring(g, 1, 1) == F.substring(i, 1, 1)) & ~(F.startswith(i, g) | F.startswith(g, i))
    conflict = F.coalesce(conflict, F.lit(False))
    credit = F.when(conflict, 0.0)
    for t, share in CREDIT.items():
        credit = credit.when(tier == t, share * w.first_author)
    cs, es = item["year_suffix"], e["suffix"]
    lacks = item["year"].isNull() | e["year"].isNull()
    both, one = cs.isNotNull() & es.isNotNull(), cs.isNotNull() | es.isNotNull()
    level = ~lacks & (item["year"] == e["year"])
    same = level & ~(both & (cs != es))
    year = F.when(same, w.year).otherwise(0.0)
    suffix = F.when(~same, 0.0).when(both | ~one, w.year_suffix).otherwise(w.year_suffix / 2)
    n, m = F.size(k["others"]), F.size(e["others"])
    shared = F.size(F.filter(k["others"], lambda a: F.exists(e["others"], lambda b: (a["exact"] == b["exact"]) | (a["bare"] == b["bare"]))))
    hits = F.when((n > 0) & (m > 0), shared).otherwise(0)
    more = F.when(n == 0, w.additional_authors).when(m == 0, w.additional_authors / 2).otherwise(hits / F.greatest(n, F.lit(1)) * w.additional_authors)
    paged = F.coalesce(F.contains(e["pages"], item["page"]), F.lit(False))
    other = F.when(item["page"].isNull() | paged, w.other).otherwise(0.0)
    total = credit + year + suffix + more + other
    points = F.least(F.lit(_POINTS), F.greatest(F.lit(0), F.floor(total * _POINTS + 0.5).cast("int")))
    code = tier
    for bit, holds in enumerate((conflict, lacks, level & both & (cs != es), ~lacks & ~same, same, same & one, hits > 0, item["page"].isNotNull() & paged)):
        code = code + F.when(F.coalesce(holds, F.lit(False)), 8 << bit).otherwise(0)
    return points, code


def _reasons(code: Column) -> Column:
    """The reasons that a pair's code stands for."""
    tier = F.when(code.bitwiseAND(7) == 1, _TIERS[1])
    for t, name in _TIERS.items():
        tier = tier.when(code.bitwiseAND(7) == t, name)
    told = [F.when(code.bitwiseAND(8 << bit) != 0, F.lit("year-suffix" if name in ("clash", "suffix") else name)) for bit, name in enumerate(_TRAITS)]
    return F.array_compact(F.array(tier, *told))


def pair_scores(citations: DataFrame, entries: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """doc_id, ord, item_ord, entry_index, score, tier, reasons of every item and entry of a document."""
    points, code = _compare(weights)
    pairs = items(citations).join(targets(entries), "doc_id").select("doc_id", "ord", "item_ord", "entry_index", points.alias("points"), code.alias("code"))
    return pairs.select("doc_id", "ord", "item_ord", "entry_index", (F.col("points") / _POINTS).alias("score"), F.col("code").bitwiseAND(7).alias("tier"), _reasons(F.col("code")).alias("reasons"))


def match_items(citations: DataFrame, entries: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """The verdict on each item: relationship, entry_index, score, tier, reasons, ambiguous (entry indexes).

    A pair is one long: points, then the place of its entry from the back, then
    its code. The greatest long of an item is its best pair, so that one hash
    aggregation over fixed-width values goes through all pairs, and reasons are
    spelled out for that pair alone. The few items with several pairs above the
    threshold are compared again for the list of them.
    """
    at, match, margin, possible = ["doc_id", "ord", "item_ord"], *(round(x * _POINTS) for x in (MATCH, MARGIN, POSSIBLE))
    points, code = _compare(weights)
    all_items, all_targets = items(citations), targets(entries)
    backward = F.lit((1 << _INDEX_BITS) - 1) - F.col("entry_index").cast("long")
    packed = F.shiftleft(F.shiftleft(points.cast("long"), _INDEX_BITS) + backward, _CODE_BITS) + code
    pairs = all_items.join(all_targets, "doc_id", "left").select(*at, F.when(F.col("entry_index").isNotNull(), packed).alias("pair"))
    points_of = F.shiftright("pair", _INDEX_BITS + _CODE_BITS)
    best = pairs.groupBy(*at).agg(F.max("pair").alias("pair"), F.count_if(points_of >= match).alias("above"))
    again = best.where("above >= 2").select(*at, points_of.cast("int").alias("most")).join(all_items, at).join(all_targets, "doc_id")
    again = again.select(*at, "most", "entry_index", points.alias("points")).where(F.col("points") >= match)
    listed = again.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("less"), "entry_index"))).alias("listed"), F.max("most").alias("most"))
    near = listed.where(F.col("listed")[1]["less"] + F.col("most") <= margin).select(*at, F.transform("listed", lambda a: a["entry_index"]).alias("near"))
    rows = best.join(near, at, "left").select(
        *at, "above", "near", points_of.cast("int").alias("points"), F.col("pair").bitwiseAND((1 << _CODE_BITS) - 1).cast("int").alias("code"),
        (F.lit((1 << _INDEX_BITS) - 1) - F.shiftright("pair", _CODE_BITS).bitwiseAND((1 << _INDEX_BITS) - 1)).cast("int").alias("top"),
    )
    verdict = (
        F.when(F.col("points").isNull(), "MISSING_REFERENCE").when(F.col("near").isNotNull(), "AMBIGUOUS").when(F.col("above") >= 1, "MATCHED")
        .when(F.col("points") >= possible, "POSSIBLE_MISMATCH").otherwise("MISSING_REFERENCE")
    )
    rows = rows.withColumn("relationship", verdict).withColumn("score", F.coalesce(F.col("points") / _POINTS, F.lit(0.0)))
    missing, unsure = F.col("relationship") == "MISSING_REFERENCE", F.col("relationship") == "AMBIGUOUS"
    told = _reasons(F.col("code"))
    return rows.select(
        *at, "relationship", F.when(F.col("relationship") == "MATCHED", F.col("top")).alias("entry_index"), "score", F.coalesce(F.col("code").bitwiseAND(7), F.lit(5)).alias("tier"),
        F.when(missing, 0.0).otherwise(F.col("score")).alias("confidence"),
        F.when(missing, F.array(F.lit("no-entry"))).when(unsure, F.array_distinct(F.concat(told, F.array(F.lit("ambiguous"))))).otherwise(told).alias("reasons"),
        F.coalesce("near", F.array().cast("array<int>")).alias("ambiguous"),
    )


def combine(citations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row a citation: the gravest verdict of its items (ties: the first), and all ambiguous entries in order of appearance."""
    grave = F.when(F.col("relationship") == "AMBIGUOUS", 3).when(F.col("relationship") == "POSSIBLE_MISMATCH", 2).when(F.col("relationship") == "MISSING_REFERENCE", 1).otherwise(0)
    rep = F.struct("relationship", "entry_index", "score", "tier", "confidence", "reasons")
    one = verdicts.groupBy("doc_id", "ord").agg(
        F.max_by(rep, F.struct(grave.alias("g"), -F.col("item_ord"))).alias("r"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("item_ord", "ambiguous"))), lambda x: x["ambiguous"]))).alias("candidates"),
    )
    rows = citations.select("doc_id", "ord", "citation_id").join(one, ["doc_id", "ord"], "left")
    return rows.select(
        "doc_id", "ord", "citation_id", F.coalesce("r.relationship", F.lit("MISSING_REFERENCE")).alias("relationship"), F.col("r.entry_index").alias("entry_index"), F.coalesce("r.score", F.lit(0.0)).alias("score"),
        F.coalesce("r.tier", F.lit(5)).alias("tier"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("r.reasons", F.array(F.lit("no-entry"))).alias("reasons"),
        F.coalesce("candidates", F.array().cast("array<int>")).alias("candidates"),
    )


def entry_status(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, entry_index, status: CITED, AMBIGUOUS_USAGE or UNUSED."""
    cited = matches.where("relationship = 'MATCHED'").select("doc_id", "entry_index", F.lit(2).alias("use"))
    unsure = matches.select("doc_id", F.explode("candidates").alias("entry_index"), F.lit(1).alias("use"))
    use = cited.unionByName(unsure).groupBy("doc_id", "entry_index").agg(F.max("use").alias("use"))
    status = F.when(F.col("use") == 2, "CITED").when(F.col("use") == 1, "AMBIGUOUS_USAGE").otherwise("UNUSED")
    return entries.select("doc_id", "entry_index").join(use, ["doc_id", "entry_index"], "left").select("doc_id", "entry_index", status.alias("status"))


def numeric_tokens(citations: DataFrame, entries: DataFrame) -> DataFrame:
    """Every number of every numeric citation bound to the entry at its place: doc_id, ord, tok_ord, index, status, entry_index, start, end."""
    rows = citations.where("family = 'numeric'").select("doc_id", "ord", "citation_id", "block_id", "block_ord", "paragraph_index", F.posexplode("tokens").alias("t", "token"))
    rows = rows.select("*", F.posexplode(F.sequence("token.first", "token.last")).alias("k", "index"))
    n = entries.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    rows = rows.join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("index") < 1, "unmatched").when(F.col("index") > F.col("n"), "out-of-range").otherwise("resolved")
    return rows.select(
        "doc_id", "ord", "citation_id", "block_id", "block_ord", "paragraph_index", F.struct("t", "k").alias("tok_ord"), "index", status.alias("status"),
        F.when(status == "resolved", (F.col("index") - 1).cast("int")).alias("entry_index"), F.col("token.start").alias("start"), F.col("token.end").alias("end"), "n",
    )
