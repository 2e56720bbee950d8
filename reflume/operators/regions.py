"""Balanced bracket regions by window functions: no Python, any length of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def balanced_regions(df: DataFrame, key: str, text: str = "text", pair: str = "()") -> DataFrame:
    """key, open_offset, close_offset, inner of all balanced regions of each text (code points, end exclusive).

    The depth after each bracket is a running sum that never falls below zero:
    the sum less its least value so far. An opening bracket at depth d closes
    at the next bracket of its text that comes back to d - 1.
    """
    opened, closed = pair
    esc = "\\" + opened, "\\" + closed
    pieces = F.split(F.col(text), f"[{esc[0]}{esc[1]}]", -1)
    found = F.regexp_extract_all(F.col(text), F.lit(f"[{esc[0]}{esc[1]}]"), F.lit(0))
    rows = df.where(F.col(text).isNotNull()).select(key, text, F.posexplode(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), found.alias("mark"))).alias("i", "x"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.sum(F.length("x.gap") + 1).over(w) - 1).withColumn("step", F.when(F.col("x.mark") == opened, 1).otherwise(-1))
    rows = rows.withColumn("sum", F.sum("step").over(w))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("sum").over(w)))
    before = Window.partitionBy(key).orderBy("i")
    rows = rows.withColumn("stray", (F.col("step") == -1) & (F.col("low") < F.coalesce(F.lag("low").over(before), F.lit(0)))).where("not stray")
    rows = rows.withColumn("level", F.col("sum") - F.col("low") + F.when(F.col("step") == -1, 1).otherwise(0))
    pairs = Window.partitionBy(key, "level").orderBy("i")
    rows = rows.withColumn("until", F.lead("at").over(pairs)).withColumn("then", F.lead("step").over(pairs))
    out = rows.where("step = 1 and then = -1")
    return out.select(
        key, F.col("at").cast("int").alias("open_offset"), (F.col("until") + 1).cast("int").alias("close_offset"),
        F.substring(F.col(text), F.col("at") + 2, F.col("until") - F.col("at") - 1).alias("inner"),
    )
