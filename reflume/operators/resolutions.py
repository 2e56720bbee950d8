"""Decisions by hand as a table (file, citation_id, choice, place): kept, changed, loaded and saved.

place is the order of a file's decisions; a citation that is decided again keeps its place.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reflume.operators.report import saved

HELD = "file string, citation_id string, choice string, place long"


def upsert(held: DataFrame, new: DataFrame) -> DataFrame:
    """held with the decisions of new (file, citation_id, choice, seq): of several the last by seq counts, citations new to a file come after its others in order of their first seq."""
    last = new.groupBy("file", "citation_id").agg(F.max_by("choice", "seq").alias("newer"), F.min("seq").alias("first"), F.lit(True).alias("told"))
    rows = held.join(last, ["file", "citation_id"], "full_outer")
    w = Window.partitionBy("file")
    rank = F.row_number().over(w.orderBy(F.asc_nulls_last("place"), "first", "citation_id"))
    place = F.coalesce("place", F.coalesce(F.max("place").over(w), F.lit(-1)) + rank - F.count("place").over(w))
    return rows.select("file", "citation_id", F.when(F.col("told"), F.col("newer")).otherwise(F.col("choice")).alias("choice"), place.cast("long").alias("place"))


def clear(held: DataFrame, *files: str) -> DataFrame:
    """held without the decisions of these files."""
    return held.where(~F.col("file").isin(*files)) if files else held


def of_file(held: DataFrame, file: str | None) -> DataFrame:
    """The decisions of one file, in order; none where no file is open."""
    return held.where(F.col("file") == F.lit(file)).orderBy("place")


def load(spark: SparkSession, path: str) -> DataFrame:
    """What save() wrote. Each line is an object of files and their lists of {citationId, chosenEntryId}.

    A missing path, lines that are no such object, and entries without two texts
    give nothing, never an error.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], HELD)
    files = lines.select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")).alias("file", "list"))
    entries = files.select("file", F.posexplode(F.try_variant_get("list", "$", "array<variant>")).alias("place", "e"))
    text = lambda name: F.when(F.schema_of_variant(F.try_variant_get("e", f"$.{name}", "variant")) == "STRING", F.try_variant_get("e", f"$.{name}", "string"))
    rows = entries.select("file", text("citationId").alias("citation_id"), text("chosenEntryId").alias("choice"), F.col("place").cast("long"))
    return rows.where("citation_id is not null and choice is not null")


def save(held: DataFrame, path: str) -> bool:
    """Writes held in place of what path has, a line a file; False where that is not possible, and then nothing is raised."""
    entry = F.struct(F.col("citation_id").alias("citationId"), F.col("choice").cast("string").alias("chosenEntryId"))
    lists = held.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", entry.alias("e")))), lambda x: x["e"]).alias("list"))
    lines = lists.select(F.to_json(F.create_map("file", "list")).alias("value"))
    return saved(lambda: lines.write.mode("overwrite").text(path))
