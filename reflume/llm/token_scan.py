"""Token counts by a separator scan over flat, unindexed token files.

A token file is a run of fixed-width little-endian ids in which an
end-of-document id closes every document; nothing says where documents begin.
Files are read in blocks. In each block one vectorised search finds the
separators. What a block cannot know (how many tokens and documents stand
before it, and where the last separator before it is) comes from a prefix scan
over the block summaries, in two levels so that one file of any length is
spread over many tasks. Tokens never leave the task that read them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reflume.llm.common import Scratch, bound_batches, tidy

#: Tokens of a block, and blocks of a group of the prefix scan.
BLOCK_TOKENS = 131_072
GROUP_BLOCKS = 4096
_TYPES = {2: "<u2", 4: "<u4"}


def count_documents(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """file, ordinal, start, n_tokens, closed of every document in the blocks (file, block, payload).

    blocks of a file are numbered from 0 without gaps; their payloads may have
    any length, whole ids each. start is a token position in the file. Tokens
    after the last separator are a document that is not closed. Null payloads
    are empty. An empty table gives an empty result.
    """
    bound_batches(blocks.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for payload in batch.column(2):
                tokens = np.frombuffer(payload.as_buffer() if payload.is_valid else b"", _TYPES[width])
                sizes.append(len(tokens))
                ends.append(np.flatnonzero(tokens == eod))
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            flat = np.concatenate(ends).astype(np.int64) if ends else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["file", "block", "size", "ends"])

    scratch = Scratch(blocks.sparkSession, "tokens")
    cols = blocks.select(F.col("file").cast("long").alias("file"), F.col("block").cast("long").alias("block"), "payload")
    found = scratch.write(cols.mapInArrow(tidy(find), "file long, block long, size long, ends array<long>").withColumn("g", F.floor(F.col("block") / GROUP_BLOCKS)), "found")
    one = found.select("file", "g", "block", "size", F.size("ends").cast("long").alias("docs"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))

    def scan(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        """Exclusive running sums of size and docs, and the last separator so far, relative to the start of the partition."""
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        base = F.coalesce(F.sum("size").over(w), F.lit(0))
        df = df.withColumn("base", base).withColumn("before", F.coalesce(F.sum("docs").over(w), F.lit(0)))
        return df.withColumn("carry", F.max(F.col("base") + F.col("last")).over(w))

    inner = scan(one, ["file", "g"], "block")
    groups = one.groupBy("file", "g").agg(F.sum("size").alias("size"), F.sum("docs").alias("docs"))
    tails = inner.groupBy("file", "g").agg(F.max(F.col("base") + F.col("last")).alias("last"))
    outer = scan(groups.join(tails, ["file", "g"]), ["file"], "g").select("file", "g", F.col("base").alias("g_base"), F.col("before").alias("g_before"), F.col("carry").alias("g_carry"))
    ends = inner.groupBy("file").agg(F.max("block").alias("final"))
    placed = (
        inner.join(outer, ["file", "g"]).join(ends, "file")
        .select(
            "file", "block", (F.col("g_base") + F.col("base")).alias("base"), (F.col("g_before") + F.col("before")).alias("before"),
            (F.coalesce(F.col("g_base") + F.col("carry"), F.col("g_carry"), F.lit(-1)) + 1).alias("open"), (F.col("block") == F.col("final")).alias("final"), "size",
        )
    )
    placed = scratch.write(placed, "placed")
    whole = found.select("file", "block", "ends").join(placed, ["file", "block"])
    stops = F.transform("ends", lambda e: e + F.col("base"))
    closed = (
        whole.where(F.size("ends") > 0)
        .select("file", "before", F.posexplode(F.arrays_zip(F.concat(F.array("open"), F.transform(F.slice(stops, F.lit(1), F.size("ends") - 1), lambda x: x + 1)).alias("start"), stops.alias("stop"))).alias("k", "x"))
        .select("file", (F.col("before") + F.col("k")).alias("ordinal"), F.col("x.start").alias("start"), (F.col("x.stop") - F.col("x.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    )
    begin = F.when(F.size("ends") > 0, F.element_at(stops, -1) + 1).otherwise(F.col("open"))
    rest = (
        whole.where("final").withColumn("start", begin).withColumn("n_tokens", F.col("base") + F.col("size") - F.col("start")).where("n_tokens > 0")
        .select("file", (F.col("before") + F.size("ends")).alias("ordinal"), "start", "n_tokens", F.lit(False).alias("closed"))
    )
    return closed.unionByName(rest)


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, payload, path) of the flat token files that path names; a file has less than 2 GB."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_buffer()
                if data.size % width:
                    raise ValueError(f"{name}: half a token at its end")
                for k, at in enumerate(range(0, data.size, block_tokens * width)):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k]), pa.array([data.slice(at, min(block_tokens * width, data.size - at)).to_pybytes()], pa.binary()), pa.array([name])], ["file", "block", "payload", "path"])

    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("file"), "content")
    return files.mapInArrow(tidy(cut), "file long, block long, payload binary, path string")


def write_tokens(docs: DataFrame, ranks: str, pattern: str, eod: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token files of docs (doc_id, text) in blocks: file, block, payload; rows with a null payload list the file's doc_ids in order.

    A file is what one task reads. ranks is a byte-level BPE vocabulary, read by
    the driver; ids that the width cannot hold are an error. Null and empty
    texts are a separator alone.
    """
    bound_batches(docs.sparkSession)
    with open(ranks, "rb") as f:
        lines = [line.split() for line in f]
    if max([eod, *(int(b) for _, b in lines)]) >= 1 << 8 * width:
        raise ValueError(f"ids of the vocabulary do not fit into {width} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in sent.value}
        coder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        file = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        size = block = listed = 0

        def rows(blocks, payloads, ids, first):
            n = len(blocks)
            return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.array(blocks, pa.int64()), pa.array(payloads, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array([first] * n, pa.int64())], ["file", "block", "payload", "doc_ids", "first"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for text in batch.column(1):
                tokens = np.asarray(coder.encode_to_numpy(text.as_py() or "", disallowed_special=()), _TYPES[width]) if text.is_valid else np.zeros(0, _TYPES[width])
                held += [tokens, np.array([eod], _TYPES[width])]
                size += len(tokens) + 1
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    whole = len(flat) // block_tokens
                    payloads = [flat[k * block_tokens : (k + 1) * block_tokens].tobytes() for k in range(whole)]
                    yield rows(range(block, block + whole), payloads, [None] * whole, 0)
                    block, held, size = block + whole, [flat[whole * block_tokens :]], len(flat) - whole * block_tokens
            yield rows([-1], [None], [ids], listed)
            listed += len(ids)
        if size:
            yield rows([block], [np.concatenate(held).tobytes()], [None], 0)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "file long, block long, payload binary, doc_ids array<long>, first long")


def document_tokens(docs: DataFrame, ranks: str, pattern: str, eod: int) -> DataFrame:
    """doc_id, n_tokens of every row of docs: written as token files, then counted by the scan alone."""
    scratch = Scratch(docs.sparkSession, "token-files")
    files = scratch.write(write_tokens(docs, ranks, pattern, eod), "files", "zstd")
    counts = count_documents(files.where("block >= 0").select("file", "block", "payload"), eod)
    names = files.where("block < 0").select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
