"""Shared pieces: written intermediate tables, folds, bounded label samples, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that one Arrow batch may hold on its way to Python.
BATCH_BYTES = 2 * 1024 * 1024
#: Edges that one task holds to contract them.
EDGES_AT_ONCE = 1_000_000
#: Rows of a few numbers each that are worth a task.
TASK_ROWS = 100_000
#: Spark's setting by which a query's shuffle files go when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes too, so that long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns what this worker's allocators hold but do not use; the worker lives on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a mapInArrow, which gives memory back as its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, a local one is made, on local masters only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.reflume.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="reflume-")
        spark.conf.set("spark.reflume.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder in the course of one query.

    Writing cuts the lineage: a lost executor costs its own tasks only, never
    the steps before a written table. What is not dropped goes when the driver
    ends.
    """

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        """lean: what a step shuffled goes as soon as its table is written, not when the driver happens to collect its garbage."""
        self.spark, self.lean = spark, lean
        self.root = f"{shared_folder(spark)}/reflume/{name}-{uuid.uuid4().hex}"
        self.n = 0
        at, files = self._files(self.root)
        files.deleteOnExit(at)  # the result may be read for as long as the driver lives

    def write(self, df: DataFrame, name: str = "t", compression: str = "snappy", few: bool = False) -> DataFrame:
        """few: dealt out anew into files of the advised size, where many tasks make little."""
        df = df.hint("rebalance") if few else df
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        try:
            if self.lean:
                self.spark.conf.set(FREE_SHUFFLES, "true")
            df.write.mode("overwrite").option("compression", compression).parquet(path)
        finally:
            if self.lean:
                self.spark.conf.unset(FREE_SHUFFLES) if before is None else self.spark.conf.set(FREE_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._reflume_path = path
        return out

    def _files(self, path: str):
        spark = self.spark.sparkContext
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(spark._jsc.hadoopConfiguration())

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for path in (getattr(t, "_reflume_path", None) for t in tables):
            if path:
                at, files = self._files(path)
                files.delete(at, True)


def held_out(doc_id: str = "doc_id"):
    """True on the fifth of the ids whose crc32 (of the id as text) is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def label_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, others: int = 0) -> DataFrame:
    """At most `most` labelled documents of each label outside the held-out fold, in id-hash order.

    Returns doc_id, text, y. The ids and labels are bounded by `most`, which
    allows the broadcast; of several labels of one id the smallest counts, and
    of several texts the least. others: at most so many documents without a
    label as well, outside that fold too, with y = -1.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    )
    one = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = one(0).unionByName(one(1))
    if others:
        first = [F.xxhash64("doc_id"), "doc_id"]
        near = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id")).orderBy(*first).limit(2 * others)
        free = near.distinct().join(labels.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti").orderBy(*first).limit(others)
        picked = picked.unionByName(free.withColumn("y", F.lit(-1)))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while len(a):
        x, y = low[a], low[b]
        go = x != y
        np.minimum.at(low, np.maximum(x, y)[go], np.minimum(x, y)[go])  # x and y are roots
        while (low[low] != low).any():
            low = low[low]
        a, b = a[go], b[go]
    return nodes, nodes[low]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) -> stars (node, least node) of what EDGES_AT_ONCE edges of a task connect."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        node, low = least_nodes(*(np.concatenate(x) for x in zip(*held, strict=True)))
        far = node != low
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(low[far])], ["u", "v"])

    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        if sum(len(x[0]) for x in held) >= EDGES_AT_ONCE:
            yield stars()
            held = []
    if held:
        yield stars()


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df in one task for each TASK_ROWS of its `rows` short rows, so that small steps do not pay for many tasks."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(node, component) of every node of the undirected edges (u, v), written; component is the smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014), until
    every node has one parent and that is a root. Before each round tasks
    contract what their own edges connect, so that few edges need no round at
    all. Each half step writes the minima and the new edges, so that the join
    against the minima can be split where one node holds many edges. edges
    should be a written table, as they are counted.
    """
    n = 2 * edges.count()

    def put(df: DataFrame, name: str) -> DataFrame:
        return scratch.write(in_tasks(df, n), name)

    def star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        low = put(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        return e.join(low, "u"), low

    def distinct(e: DataFrame) -> DataFrame:
        return e.where("u > v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")

    def contract(e: DataFrame) -> DataFrame:
        return in_tasks(e, n).mapInArrow(tidy(_contract), "u long, v long")

    def settled(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("all"))
        return in_tasks(ends.where("up > 1 or (up = 1 and all > 1)"), n).count() == 0

    now = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u > v")
    for k in range(rounds):
        stars = put(distinct(contract(now)), "stars")
        if k:
            scratch.drop(now)
        now = stars
        if settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, low1 = star(both)
        large = put(distinct(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        joined, low2 = star(large)
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        after = put(small.where("u > v"), "small")
        scratch.drop(now, low1, large, low2)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return put(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
