"""Embedding near-duplicates: sign hashing, exact cosines, connected components.

Vectors are compared only with vectors of the same label and length. Equal
vectors form a class first, so copies cost nothing later. Every class gets one
signature of `bits` random-hyperplane signs in each of `tables` tables; classes
that share a signature in any table are compared by exact cosine in double
precision, as blocks of a matrix product within the bucket. No pair is ever
written out: a block gives each of its vectors a number of links and a spanning
star, whatever its size. Buckets above `tile` vectors are cut into tiles, and
each pair of tiles is a group of its own.

A pair that collides in several tables is counted in the first of them only,
which the signatures of both vectors tell.

Chance that a pair at cosine c is found: 1 - (1 - (1 - acos(c) / pi) ** bits) ** tables,
which is 0.988 at 0.93 and 0.9999 at 0.97 with the defaults.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reflume.llm.common import Scratch, bound_batches, connected_components, tidy


@lru_cache(maxsize=8)
def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.rint(np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits)) * 2**10)


def _unit(values: np.ndarray, dim: int) -> np.ndarray:
    rows = values.astype(np.float64, copy=False).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _signatures(unit: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    # whole numbers whose sums stay below 2 ** 53: no sign depends on the order of adding
    signs = np.rint(unit * 2**20) @ _planes(unit.shape[1], tables, bits, seed) >= 0
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _sign(tables: int, bits: int, seed: int, whole: bool):
    """One row a vector and table; with the vector itself if whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                dims = part.column(2).to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    rows = part.take(pa.array(np.flatnonzero(dims == dim)))
                    unit = _unit(rows.column(4).flatten().to_numpy(zero_copy_only=False), int(dim))
                    sigs = _signatures(unit, tables, bits, seed)
                    for t in range(tables):
                        cols = [pa.array(np.full(len(unit), t, np.int32)), rows.column(1), rows.column(2), pa.array(sigs[:, t])]
                        names = ["t", "label", "dim", "sig"]
                        if whole:
                            cols += [rows.column(0), rows.column(3), rows.column(4)]
                            names += ["rep", "m", "emb"]
                        yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _blocks(threshold: float, tables: int, bits: int, seed: int):
    """Groups sorted by (t, label, dim, sig, i, j): kind 0 counts links, kind 1 gives spanning edges."""

    def one(t: int, dim: int, right, rep, m, emb) -> list[list[np.ndarray]]:
        unit = _unit(emb, dim)
        square = not right.any()
        a = np.arange(len(rep)) if square else np.flatnonzero(right == 0)
        b = a if square else np.flatnonzero(right == 1)
        if not len(a) or not len(b):
            return []
        hit = unit[a] @ unit[b].T >= threshold
        if square:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return []
        keep_a, keep_b = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        hit, a, b = hit[np.ix_(keep_a, keep_b)], a[keep_a], b[keep_b]
        low_a, low_b = rep[a].copy(), rep[b].copy()
        top = np.iinfo(np.int64).max
        while True:
            new_a = np.minimum(low_a, np.where(hit, low_b[None, :], top).min(1))
            new_b = np.minimum(low_b, np.where(hit, new_a[:, None], top).min(0))
            if (new_a == low_a).all() and (new_b == low_b).all():
                break
            low_a, low_b = new_a, new_b
        first = hit
        sig_a, sig_b = _signatures(unit[a], tables, bits, seed), _signatures(unit[b], tables, bits, seed)
        for s in range(t):
            first = first & (sig_a[:, s][:, None] != sig_b[:, s][None, :])
        out = [[np.zeros(len(a), np.int32), rep[a], first @ m[b]]]
        if not square:
            out.append([np.zeros(len(b), np.int32), rep[b], first.T @ m[a]])
        for ids, low in ((rep[a], low_a), (rep[b], low_b)):
            far = ids != low
            out.append([np.ones(int(far.sum()), np.int32), ids[far], low[far]])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def work(table: pa.Table, last: bool):
            table = table.combine_chunks()
            keys = [table.column(k).to_numpy() for k in range(6)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            begins, ends = np.concatenate([[0], change]), np.concatenate([change, [len(keys[0])]])
            stop = len(begins) if last else len(begins) - 1
            parts = []
            for k in np.flatnonzero(ends - begins > 1):
                if k < stop:
                    rows = table.slice(begins[k], ends[k] - begins[k])
                    right, rep, m = (rows.column(x).to_numpy() for x in (6, 7, 8))
                    parts += one(int(keys[0][begins[k]]), int(keys[2][begins[k]]), right, rep, m, rows.column(9).combine_chunks().flatten().to_numpy())
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["kind", "a", "b"]) if parts else None
            return made, None if last else table.slice(begins[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            made, rest = work(pa.concat_tables([rest, table]) if rest is not None else table, False)
            if made is not None:
                yield made
        if rest is not None:
            made, _ = work(rest, True)
            if made is not None:
                yield made

    return run


def cosine_components(
    vectors: DataFrame, threshold: float = 0.93, tables: int = 24, bits: int = 14, tile: int = 1024, seed: int = 20240611
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label, any more columns).

    n_links counts the other rows linked directly, component_id is the smallest
    vec_id reachable, kept says that it is the row's own. Rows whose label is
    null, or whose vector is null, empty, zero or holds null or non-finite
    components, link with nothing; rows without a vec_id link with nothing and
    have neither component_id nor kept. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "cosine")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    part = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"  # as they travel; all sums are in doubles
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{part}>").alias("emb"))
    good = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("emb") > 0, F.lit(False))
        & F.coalesce(F.forall("emb", finite), F.lit(False)) & F.coalesce(F.exists("emb", lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("good", good).withColumn("k1", F.xxhash64("label", "emb")).withColumn("k2", F.xxhash64(F.lit(1), "emb", "label"))
    members = scratch.write(rows.select("vec_id", "good", "k1", "k2"), "members")
    classes = scratch.write(
        rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.any_value("label").alias("label"), F.count("*").alias("m"), F.any_value("emb").alias("emb"))
        .select("k1", "k2", "rep", "label", F.size("emb").alias("dim"), "m", "emb"),
        "classes",
    )
    vecs = classes.select("rep", "label", "dim", "m", "emb")
    key = ["t", "label", "dim", "sig"]
    crowded = scratch.write(
        vecs.mapInArrow(tidy(_sign(tables, bits, seed, False)), "t int, label long, dim int, sig long").groupBy(*key).count().where(F.col("count") > tile)
        .select(*key, F.ceil(F.col("count") / tile).cast("int").alias("tiles")),
        "crowded",
    )
    spread = (
        vecs.mapInArrow(tidy(_sign(tables, bits, seed, True)), f"t int, label long, dim int, sig long, rep long, m long, emb array<{part}>")
        .join(crowded, key, "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(*key, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("right"), "rep", "m", "emb")
    )
    group = [*key, "i", "j"]
    found = scratch.write(
        spread.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(_blocks(threshold, tables, bits, seed)), "kind int, a long, b long"), "found"
    )
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    comps = connected_components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    told = scratch.write(
        classes.select("k1", "k2", "rep", "m").join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")),
        "told",
    )
    joined = members.where("good").join(told, ["k1", "k2"], "left").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = members.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
