"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Every source is cut into blocks of documents by a hash, so a
source's blocks in order are a random permutation of it. A source whose target
is above its size gives whole passes over its blocks, and then its first blocks
until the target is met; in the block where that happens documents count one by
one, in hash order.

Which output shard gets which block is decided without a global shuffle: a
binary tree splits the vector of block quotas (one entry a source) by drawing
the left half's share from the multivariate hypergeometric distribution, down
to single shards. That is how a shuffled deck would fall, so each shard holds
the mix in miniature and the quotas are met exactly. The source's block copies,
permuted, are then dealt to the shards in disjoint runs, and each shard orders
its own rows by a hash.

What reaches the driver: one row a source and one number a block, both bounded
(MOST_SOURCES, MOST_BLOCKS) and checked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reflume.llm.common import Scratch, free_name

MOST_SOURCES = 100_000
MOST_BLOCKS = 65_536
#: Words of an output shard, the least number of shards, and of blocks a shard.
SHARD_WORDS, LEAST_SHARDS, SHARD_BLOCKS = 20_000_000, 64, 8
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight; none above cap times its size, the excess shared again by weight."""
    out: list[float | None] = [None] * len(sizes)
    while True:
        free = [k for k, x in enumerate(out) if x is None]
        if not free:  # the share is above what all sources may give
            return [float(x) for x in out]
        left = total - sum(x for x in out if x is not None)
        weight = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / weight > cap * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / weight
            return [float(x) for x in out]
        for k in over:
            out[k] = cap * sizes[k]


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many blocks of each source each shard gets. Columns sum to the quotas; row sums differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def walk(counts: np.ndarray, first: int, last: int, room: np.ndarray) -> None:
        if last - first == 1:
            out[first] = counts
            return
        middle = (first + last) // 2
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(counts, int(room[first:middle].sum()), method="marginals")
        walk(left, first, middle, room)
        walk(counts - left, middle, last, room)

    total = int(quotas.sum())
    walk(quotas.astype(np.int64), 0, shards, np.diff(np.arange(shards + 1) * total // shards))
    return out


def plan(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int | None = None, block_words: int = 50_000, seed: int = 7, key: Column | None = None
) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards of every row of docs (doc_id, text, source, any more columns).

    Sources in code-point order, null last, weigh `weights` in turn and share
    `share` of all words; no target is above `cap` (an integer) times the size.
    taken is the words that the mix takes of the row (repeats counted); shards
    holds the output shard of each of its copies. Null and empty texts have
    size 0. Equal rows are kept apart. An empty table gives an empty result.
    key: one more column of the result, k, by which to find the rows again.
    shards: by default one for each SHARD_WORDS words that the mix takes, LEAST_SHARDS
    at least and MOST_BLOCKS / SHARD_BLOCKS at most, beyond which shards grow.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    more = ["k"] if key is not None else []
    sized = scratch.write(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")).alias("key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("h"), *([key.alias("k")] if key is not None else []),
        ),
        "sized",
    )
    per = sized.groupBy("key").agg(F.sum("size").alias("z")).limit(MOST_SOURCES + 1).collect()
    if len(per) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not per:
        return sized.select("doc_id", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"), F.array().cast("array<int>").alias("shards"), *more)
    per = sorted(((r.key, int(r.z)) for r in per), key=lambda x: (x[0] == "-", x[0]))
    sizes = [z for _, z in per]
    target = targets(sizes, [weights[k % len(weights)] for k in range(len(per))], share * sum(sizes), cap)
    if shards is None:
        shards = max(LEAST_SHARDS, min(MOST_BLOCKS // SHARD_BLOCKS, int(sum(target) / SHARD_WORDS) + 1))
    step = max(block_words, 2 * sum(sizes) // MOST_BLOCKS + 1)
    blocks = [max(1, z // step) for z in sizes]
    passes = [0 if not z else min(int(cap), int(t // z)) for z, t in zip(sizes, target, strict=True)]
    rest = [t - p * z for z, t, p in zip(sizes, target, passes, strict=True)]
    sources = spark.createDataFrame(
        [(k, n, z, t, b, p, r) for n, ((k, z), t, b, p, r) in enumerate(zip(per, target, blocks, passes, rest, strict=True))],
        "key string, sid int, source_size long, target double, blocks int, passes int, rest double",
    )
    rows = sized.join(F.broadcast(sources), "key").withColumn("block", F.pmod("h", F.col("blocks")).cast("int"))
    by_block = scratch.write(rows.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.any_value("rest").alias("rest")), "blocks")
    held = by_block.withColumn("before", F.sum("words").over(Window.partitionBy("sid").orderBy("block")) - F.col("words")).where("words > 0")
    held = scratch.write(
        held.select("sid", "block", "rest", "before", (F.col("before") + F.col("words") <= F.col("rest")).alias("whole"), ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))).alias("edge")), "held"
    )

    first = np.cumsum([0, *blocks])  # number of each source's block 0
    seen = held.select("sid", "block", F.expr("int(whole) + 2 * int(edge)").alias("state")).toPandas()  # at most MOST_BLOCKS + one a source
    owner = seen["sid"].to_numpy(np.int64)
    block = seen["block"].to_numpy(np.int64)
    copies = np.array(passes, np.int64)[owner] + (seen["state"].to_numpy() > 0)
    instance_sid = np.repeat(owner, copies)
    instance_block = np.repeat(block, copies)
    instance_pass = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    quotas = np.bincount(instance_sid, minlength=len(per))
    dealt = split_quotas(quotas, shards, seed)
    order = np.lexsort((instance_pass, instance_block, instance_sid))
    shard = np.zeros(len(order), np.int64)
    at = 0
    for sid, quota in enumerate(quotas):
        mine = order[at : at + quota]
        mine = mine[np.random.default_rng([seed, sid, 1]).permutation(quota)]
        shard[mine] = np.repeat(np.arange(shards), dealt[:, sid])
        at += quota
    where = np.full((int(first[-1]), int(cap) + 1), -1, np.int64)
    where[first[instance_sid] + instance_block, instance_pass] = shard
    places = spark.createDataFrame(
        [(int(s), int(b), [int(x) for x in where[first[s] + b] if x >= 0]) for s, b in zip(owner, block, strict=True)], "sid int, block int, places array<int>"
    )
    edge = (
        rows.join(F.broadcast(held.where("edge").select("sid", "block", "before")), ["sid", "block"])
        .withColumn("end", F.col("before") + F.sum("size").over(Window.partitionBy("sid", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("more", (F.col("end") - F.col("size") / 2 <= F.col("rest")))
    )
    flat = held.select("sid", "block", "whole", "edge")
    calm = rows.join(F.broadcast(flat), ["sid", "block"], "left").where("edge is null or not edge").withColumn("more", F.coalesce("whole", F.lit(False)))
    cols = ["doc_id", "size", "source_size", "target", "passes", "sid", "block", "more", *more]
    both = calm.select(*cols).unionByName(edge.select(*cols)).join(F.broadcast(places), ["sid", "block"], "left")
    times = F.when(F.col("size") > 0, F.col("passes") + F.col("more").cast("int")).otherwise(0)
    return both.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"),
        F.slice(F.coalesce("places", F.array().cast("array<int>")), F.lit(1), times).alias("shards"), *more,
    )


def mix(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mixed rows themselves: the columns of docs, shard and copy, ordered at random within each shard.

    Rows are found again by 128 bits of hashes of doc_id, text and source. Equal
    rows share them; they count as one row with the copies of all of them. Rows
    with a null doc_id are mixed like others. Columns named shard or copy are
    replaced; all others, whatever their names, stay.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.drop("shard", "copy")
    k, places = free_name(docs, "_k"), free_name(docs, "_places")
    nulls = F.concat_ws("|", *(F.col(c).isNull().cast("string") for c in ("doc_id", "text", "source")))
    key = F.struct(F.xxhash64("doc_id", "text", "source", nulls).alias("a"), F.xxhash64(F.lit(seed), nulls, "source", "text", "doc_id").alias("b"))
    per = plan(docs, seed=seed, key=key, **options).groupBy("k").agg(F.flatten(F.collect_list("shards")).alias(places), F.count("*").alias("n"))
    per = scratch.write(per.withColumnRenamed("k", k), "copies")
    rows, again = docs.withColumn(k, key), per.where("n > 1").select(k)
    if not again.isEmpty():
        rows = rows.join(again, k, "left_anti").unionByName(rows.join(again, k, "left_semi").dropDuplicates([k]))
    rows = rows.join(per.where(F.size(places) > 0).select(k, places), k).select("*", F.posexplode(places).alias("copy", "shard")).drop(places)
    return rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 1), k, "copy")).drop(k)
