"""Finding the bibliography section, and its entries, by windows over a document's blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from reflume import schema
from reflume.functions import grammar, recalled, text

#: Headings, weights and the threshold.
HEADINGS = ("References", "Reference", "Bibliography", "Works Cited", "Literature Cited", "Tài liệu tham khảo", "Danh mục tài liệu tham khảo")
WEIGHTS = {"exact": 0.35, "heading": 0.15, "late": 0.20, "following": 0.30}
THRESHOLD, LOOKAHEAD = 0.6, 3
_DASHES = "’“”&–"
LIKE = rf"^\p{{L}}(?:[\p{{L}}.,'{_DASHES}-]|{grammar.WS}){{1,80}}\([0-9]{{4}}\)[.:]"
LIKE_ENTRY = rf"^\p{{L}}(?:[\p{{L}}\p{{M}}.,'{_DASHES}-]|{grammar.WS}){{1,80}}\([0-9]{{4}}\)[.:]"


def reference_like(c: Column) -> Column:
    """Whether a text begins like an entry; most are told by the end of the year's parenthesis before the pattern is tried."""
    return (F.contains(c, F.lit(").")) | F.contains(c, F.lit("):"))) & c.rlike(LIKE)


def _is_heading(c: Column) -> Column:
    """Whether a text folds to one of HEADINGS. None has a stop or parenthesis, and folding takes none away."""
    folded = [grammar.plain(h).lower() for h in HEADINGS]
    return F.when(F.contains(c, F.lit("(")) | F.contains(c, F.lit(".")), False).otherwise(text.fold(c).isin(*folded))


def body_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that are not notes, numbered from 0 within the document, with how many there are."""
    order = Window.partitionBy("doc_id").orderBy("block_ord")
    body = blocks.where(~F.col("type").isin("footnote", "endnote"))
    return body.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))


def _scored(blocks: DataFrame) -> DataFrame:
    """Body blocks with what tells a head: hit (0 or 1), following, exact, is_heading, late."""
    body = body_blocks(blocks).withColumn("hit", reference_like(F.col("text")).cast("int"))
    ahead = Window.partitionBy("doc_id").orderBy("block_ord").rowsBetween(1, LOOKAHEAD)
    return (
        body.withColumn("following", F.coalesce(F.sum("hit").over(ahead), F.lit(0)) / LOOKAHEAD)
        .withColumn("exact", _is_heading(F.col("text"))).withColumn("is_heading", F.col("type") == "heading").withColumn("late", F.col("i") >= F.col("n") / 2)
    )


def _may_head() -> Column:
    return (F.col("exact") | F.col("is_heading")) & (text.trim(F.col("text")) != "")


def _total() -> Column:
    part = lambda flag, name: F.when(F.col(flag), WEIGHTS[name]).otherwise(0.0)
    return F.least(F.lit(1.0), part("exact", "exact") + part("is_heading", "heading") + part("late", "late") + F.col("following") * WEIGHTS["following"])


def candidates(blocks: DataFrame) -> DataFrame:
    """doc_id, block_id, heading, heading_type, start_index, confidence of every block that may head a bibliography."""
    scored = _scored(blocks).where(_may_head())
    kind = F.when(F.col("exact"), "exact").when(F.col("following") > 0, "reference-segment").when(F.col("late"), "position").when(F.col("is_heading"), "style").otherwise("none")
    return scored.select("doc_id", "block_id", F.col("text").alias("heading"), kind.alias("heading_type"), F.col("i").alias("start_index"), _total().alias("confidence"))


def detect(blocks: DataFrame) -> DataFrame:
    """doc_id, outcome, block_id, heading, confidence of every document; outcome detected, below-threshold or none."""
    found = candidates(blocks).groupBy("doc_id").agg(F.max_by(F.struct("block_id", "heading", "confidence"), F.struct("confidence", -F.col("start_index"))).alias("best"))
    docs = blocks.select("doc_id").distinct()
    best = docs.join(found, "doc_id", "left").select("doc_id", "best.*")
    outcome = F.when(F.col("confidence").isNull(), "none").when(F.col("confidence") >= THRESHOLD, "detected").otherwise("below-threshold")
    return best.select("doc_id", outcome.alias("outcome"), "block_id", "heading", "confidence")


def sections(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """doc_id, block_id, section_ord of the blocks that belong to each head (doc_id, head_id): head, leading gap, run of entries.

    Blocks after the head form a run that the first break ends. A gap counts
    only before the first entry, where an entry follows within the lookahead.
    """
    body = body_blocks(blocks).join(heads, "doc_id").withColumn("is_head", F.col("block_id") == F.col("head_id"))
    body = body.withColumn("h", F.max(F.when(F.col("is_head"), F.col("i"))).over(Window.partitionBy("doc_id"))).withColumn("hit", reference_like(F.col("text")))
    return _run(body).select("doc_id", "block_id", "section_ord")


def detected_sections(blocks: DataFrame) -> DataFrame:
    """sections() of the heads that are detected, with block_ord, paragraph_index and text of each block: windows of one order alone."""
    body = _scored(blocks)
    head = F.when(_may_head(), F.struct(_total().alias("confidence"), (-F.col("i")).alias("back")))
    body = body.withColumn("best", F.max(head).over(Window.partitionBy("doc_id"))).where(F.col("best.confidence") >= THRESHOLD)
    body = body.withColumn("h", -F.col("best.back")).withColumn("is_head", F.col("i") == F.col("h")).withColumn("hit", F.col("hit") == 1)
    return _run(body).select("doc_id", "block_id", "section_ord", "block_ord", "paragraph_index", "text")


def _run(body: DataFrame) -> DataFrame:
    """Body blocks (i, hit, is_head, and h, the head's i) that belong to the head, with section_ord."""
    w = Window.partitionBy("doc_id").orderBy("block_ord")  # the order of i, in which the rows lie already
    soon = F.coalesce(F.max(F.col("hit").cast("int")).over(w.rowsBetween(1, LOOKAHEAD)), F.lit(0)) == 1
    body = body.withColumn("soon", soon).where("i >= h")
    after = w.rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("entries", F.coalesce(F.sum(F.when(~F.col("is_head"), F.col("hit").cast("int"))).over(after), F.lit(0)))
    gap = (F.col("entries") == 0) & (text.trim(F.col("text")) != "") & (F.col("type") != "heading") & ~F.col("text").rlike(r"\([0-9]{4}\)") & F.col("soon")
    body = body.withColumn("broken", F.sum((~(F.col("is_head") | F.col("hit") | gap)).cast("int")).over(after)).where("broken = 0")
    last = F.max(F.when(F.col("is_head") | F.col("hit"), F.col("i"))).over(Window.partitionBy("doc_id"))
    return body.withColumn("last", last).where("i <= last").withColumn("section_ord", F.col("i") - F.col("h"))


def bibliography(blocks: DataFrame, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, outcome, heading, confidence; section blocks: doc_id, block_id, section_ord).

    chosen (doc_id, block_ids array<string>): sections picked by hand. One id
    is a head and spans as usual, several are the section as they are; ids that
    do not exist leave an empty detected section without confidence.
    """
    found = detect(blocks)
    auto = detected_sections(blocks)
    if chosen is None:
        return found.select("doc_id", "outcome", "heading", "confidence"), auto
    picked = chosen.select(F.col("doc_id"), "block_ids")
    told = found.join(picked, "doc_id", "left").select(
        "doc_id", F.when(F.col("block_ids").isNotNull(), "detected").otherwise(F.col("outcome")).alias("outcome"),
        F.when(F.col("block_ids").isNull(), F.col("heading")).alias("heading"), F.when(F.col("block_ids").isNull(), F.col("confidence")).alias("confidence"),
    )
    single = sections(blocks, picked.where(F.size("block_ids") == 1).select("doc_id", F.col("block_ids")[0].alias("head_id")))
    many = picked.where(F.size("block_ids") > 1).select("doc_id", F.posexplode("block_ids").alias("section_ord", "block_id")).join(blocks.select("doc_id", "block_id"), ["doc_id", "block_id"])
    rest = auto.select("doc_id", "block_id", "section_ord").join(picked.select("doc_id"), "doc_id", "left_anti")
    return told, rest.unionByName(single).unionByName(many.select("doc_id", "block_id", "section_ord"))


def entry_blocks(blocks: DataFrame, section: DataFrame) -> DataFrame:
    """Blocks of entries, numbered from 0: the section without its head, unless that is an entry itself."""
    rows = section if "text" in section.columns else section.join(blocks.select("doc_id", "block_id", "block_ord", "paragraph_index", "text"), ["doc_id", "block_id"])
    w = Window.partitionBy("doc_id").orderBy("block_ord" if rows is section else "section_ord")
    rows = rows.withColumn("k", F.row_number().over(w)).where((F.col("k") > 1) | F.col("text").rlike(LIKE_ENTRY))
    return rows.select("doc_id", (F.row_number().over(w) - 1).alias("entry_index"), "block_id", "block_ord", "paragraph_index", F.col("text").alias("raw"))


def parse_entries(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Reference entries as records; failure says why one cannot be read. columns: those wanted, all by default."""
    fields = [f for f in T.StructType.fromDDL(schema.ENTRIES) if columns is None or f.name in columns]
    kind = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])
    given = [f.name for f in fields if f.name in rows.columns]
    made = pa.schema([kind.field(f.name) for f in fields if f.name not in rows.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = recalled.rows(("entries", made.to_string()), lambda t: [grammar.entry(t)], made)
        for batch in batches:
            columns = {name: batch.column(name).cast(kind.field(name).type) for name in given}
            if len(made):
                at, out = known([t or "" for t in batch.column("raw").to_pylist()])
                columns = {name: c.take(pa.array(at)) for name, c in columns.items()} | dict(zip(made.names, out.columns, strict=True))
            yield pa.RecordBatch.from_arrays([columns[name] for name in kind.names], schema=kind)

    return rows.select(*dict.fromkeys([*given, "raw"])).mapInArrow(run, T.StructType(fields))


def _arrow(spark, ddl: str) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(ddl)])
