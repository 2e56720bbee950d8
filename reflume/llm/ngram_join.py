"""N-gram Jaccard join with set-relation skipping.

Every document becomes the set of its distinct word shingles; documents link
when 100 * |A & B| >= 100t * |A | B|. The join is exact:

1. Documents with equal sets form a class, which is named by a 64-bit digest of
   the set. Only one copy of a class travels from each partition.
2. The tokens of a set are ordered by (how common, hash). Two linked sets share
   a token within their prefixes of n - ceil(t n) + 1 tokens, whatever the
   order. A bounded table of the most common tokens only improves the order.
3. Index level: the list of a token is sorted by set size and position and read
   in blocks. Members that size or position rule out are skipped unseen, and the
   others are paired with the list's leader alone (the smallest set that can
   still link with them), so a list costs its length.
4. Answer level: overlaps with a leader are computed once. For two members B
   and C of one list that are in different components so far, those overlaps
   bound |B & C| from both sides: |A & C| + |B - A| above and
   |A & B| + |A & C| - |A| below. Most pairs are settled by these; what remains
   is compared in steps, a few partners of each member at first, as one link
   joins it to a whole component. The last step leaves nothing out.
5. Components of all links by large-star/small-star.

Very common tokens are salted; a portion of a list has a leader of its own, and
portions are joined through their leaders. Lists of which all members already
belong to one component are left out of step 4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reflume.llm.common import Scratch, bound_batches, connected_components, in_tasks, tidy
from reflume.llm.words import mix, shingle_sets

#: Most common tokens that are known to every task: 12 bytes each.
COMMON_TOKENS = 131_072
#: Tokens of sets read between two looks at which of them are common.
WINDOW_TOKENS = 2_000_000
#: Documents of a window that make a token common.
COMMON_IN_WINDOW = 2
#: Partners that a member is compared with in each further step, before components are looked at again; None: all that
#: remain. Only lists of which a step left pairs out are in the next.
STEPS = (4, 64, None)
#: Members of a list's portion, and of a tile of the second step.
PORTION = 1024
#: Ids that may be broadcast: 8 bytes each.
FEW_IDS = 500_000
#: Classes whose digests a task remembers, not to send their prefixes again.
SEEN_CLASSES = 500_000
#: Members of one list held in memory at once.
LONGEST_RUN = 1_000_000

_PAIRS = "kind int, token long, salt int, cls long, leader long, n int, pos int, leader_n int"


def _digest(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        place = np.arange(1, len(tokens) + 1, dtype=np.uint64)
        return int(mix(np.atleast_1d(np.sum(mix(tokens + place * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64) + np.uint64(len(tokens)))).view(np.int64)[0])


def _describe(width: int):
    """Rows of kind 0: doc_id, n, class. Rows of kind 1: a common token and how many sets of a window hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[np.ndarray] = []
        held, seen = 0, set()

        def common() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(window), return_counts=True) if window else (np.zeros(0, np.uint64),) * 2
            many = counts >= COMMON_IN_WINDOW
            k = int(many.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(counts[many].astype(np.int32)), pa.array(tokens[many].view(np.int64))], ["kind", "doc_id", "n", "cls"])

        for batch in batches:
            sizes, names = [], []
            for tokens in shingle_sets(batch.column(1), width):
                name = _digest(tokens) if len(tokens) else 0
                sizes.append(len(tokens))
                names.append(name)
                if len(tokens) and name not in seen:
                    seen.add(name)
                    window.append(tokens)
                    held += len(tokens)
                    if held >= WINDOW_TOKENS:
                        yield common()
                        window, held, seen = [], 0, set()
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), batch.column(0), pa.array(sizes, pa.int32()), pa.array(names, pa.int64())], ["kind", "doc_id", "n", "cls"])
        yield common()

    return run


def _prefixes(width: int, percent: int, common: np.ndarray, counts: np.ndarray):
    """(token, salt, class, n, position) for the prefix of each class that the partition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << 20, bool)  # by the tokens' high bits; most tokens are told from common ones by this alone
        known[(common >> np.uint64(44)).view(np.int64)] = True
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for tokens in shingle_sets(batch.column(0), width):
                n = len(tokens)
                if not n:
                    continue
                name = _digest(tokens)
                if name in seen:
                    continue
                seen.add(name)
                if len(seen) > SEEN_CLASSES:
                    seen.clear()
                most = n - (percent * n + 99) // 100 + 1
                many = np.zeros(n, np.int64)
                maybe = np.flatnonzero(known[(tokens >> np.uint64(44)).view(np.int64)])
                if len(maybe):
                    at = np.minimum(np.searchsorted(common, tokens[maybe]), len(common) - 1)
                    hit = common[at] == tokens[maybe]
                    many[maybe[hit]] = counts[at[hit]]
                order = np.argsort(many, kind="stable")[:most]  # tokens ascend already
                token = tokens[order].view(np.int64)
                salts = (np.uint64(name & (2**64 - 1)) >> np.uint64(8)) % np.maximum(many[order] // PORTION, 1).astype(np.uint64)
                salt = np.where(many[order] >= 2 * PORTION, salts.astype(np.int64) + 1, 0)
                out.append((token, salt.astype(np.int32), np.full(len(order), name, np.int64), np.full(len(order), n, np.int32), np.arange(len(order), dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["token", "salt", "cls", "n", "pos"])

    return run


def _lists(percent: int):
    """Reads lists sorted by (token, salt, n, pos, class).

    Kind 0: a member and its leader to compare. Kind 1: a member of a list that
    the second step must look at, with its leader. Kind 2: the first leader of
    a portion of a salted or cut list.
    """
    names = ["kind", "token", "salt", "cls", "leader", "n", "pos", "leader_n"]

    def one(token, salt, cls, n, pos, cut) -> list[np.ndarray]:
        lead = np.zeros(len(cls), np.int64)
        first = 0
        while first < len(cls):  # a block: all that the leader's size allows
            end = int(np.searchsorted(n, 100 * int(n[first]) // percent, "right"))
            end = max(end, first + 1)
            lead[first:end] = first
            first = end
        need = (percent * (n.astype(np.int64) + n[lead]) + 99 + percent) // (100 + percent)
        fits = np.minimum(n - pos, n[lead] - pos[lead]) >= need
        compare = (lead != np.arange(len(cls))) & fits & (cls != cls[lead])
        parts = []

        def put(kind: int, keep: np.ndarray) -> None:
            k = int(keep.sum())
            if k:
                parts.append([np.full(k, kind, np.int32), np.full(k, token, np.int64), np.full(k, salt, np.int32), cls[keep], cls[lead][keep], n[keep], pos[keep], n[lead][keep]])

        put(0, compare)
        if len(cls) >= 3 or salt or cut:
            put(1, np.ones(len(cls), bool))
        if salt or cut:
            put(2, np.arange(len(cls)) == 0)
        return parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        was_cut = False

        def work(cols: list[np.ndarray], last: bool):
            nonlocal was_cut
            token, salt, cls, n, pos = cols
            change = np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1])) + 1
            begins = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(token)]])
            parts: list[list[np.ndarray]] = []
            stop = len(begins) if last else len(begins) - 1
            cut = not last and stop == 0 and len(token) >= LONGEST_RUN
            for k in np.flatnonzero((ends - begins > 1) | (salt[begins] > 0) | (np.arange(len(begins)) == 0) & was_cut):
                if k < stop or cut:
                    a, b = begins[k], ends[k]
                    parts += one(token[a], salt[a], cls[a:b], n[a:b], pos[a:b], cut or (was_cut and k == 0))
            if cut:
                was_cut, left = True, None
            else:
                left = None if last else [c[begins[-1] :] for c in cols]
                was_cut = was_cut and len(begins) == 1 and not last
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names) if parts else None
            return made, left

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(rest, cols, strict=True)]
            made, rest = work(cols, False)
            if made is not None:
                yield made
        if rest is not None:
            made, _ = work(rest, True)
            if made is not None:
                yield made

    return run


def _overlaps(width: int):
    """Rows sorted by (leader, salt, member or not): the leader's text comes first in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, base, before = None, None, None
        for batch in batches:
            leader, salt, cls, member = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            a, b, n_a, n_b, both = [], [], [], [], []
            for k, own in enumerate(shingle_sets(batch.column(4), width)):
                if not len(own) or _digest(own) != cls[k]:  # an id may stand for several texts
                    continue
                if not member[k]:
                    group, base = (leader[k], salt[k]), own.copy()
                    continue
                if group != (leader[k], salt[k]):
                    raise ValueError("a set is missing")
                if before == (group, cls[k]):
                    continue
                before = (group, cls[k])
                at = np.minimum(np.searchsorted(base, own), len(base) - 1)
                a.append(leader[k])
                b.append(cls[k])
                n_a.append(len(base))
                n_b.append(len(own))
                both.append(int((base[at] == own).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n_a, pa.int32()), pa.array(n_b, pa.int32()), pa.array(both, pa.int32())], ["leader", "cls", "leader_n", "n", "both"])

    return run


def _compare(docs: DataFrame, reps: DataFrame, pairs: DataFrame, rows: int, width: int, scratch: Scratch, every: bool = False) -> DataFrame:
    """Exact overlaps of the pairs (leader, cls). A class's text goes where its set is needed: packed, it is less than half of the set's hashes.

    rows: how many pairs and classes there are.
    """
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / 256).cast("int").alias("salts"))
    spread = pairs.join(salts, "leader").withColumn("salt", F.pmod(F.col("cls"), F.col("salts")).cast("int"))
    to = F.struct(F.col("leader"), F.col("salt"), F.col("member")).alias("to")
    lead = salts.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("leader").alias("cls"))
    sent = spread.select("leader", "salt", F.lit(1).alias("member"), "cls").unionByName(lead).select("cls", to)
    # a leader of very many portions gets several rows of targets, each bounded
    goes = sent.groupBy("cls", F.floor(F.col("to.salt") / 64).alias("part")).agg(F.collect_list("to").alias("goes"))
    goes = goes.join(reps, "cls").select("cls", "goes", F.col("rep").alias("doc_id"))
    goes = scratch.write(in_tasks(goes, rows), "goes")
    # ids alone decide which texts move: no more than FEW_IDS are broadcast, and then few texts move. Where most
    # are wanted (every), texts are dealt out at every size, so that the cost stays in proportion
    few = not every and goes.count() <= FEW_IDS
    ids = goes.select("doc_id").distinct()
    wanted = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi")
    texts = wanted.join(goes.hint("merge"), "doc_id").select("cls", "text", "goes")
    delivered = texts.select("cls", F.explode("goes").alias("to"), "text").select("to.leader", "to.salt", "cls", "to.member", "text")
    return (
        delivered.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member", "cls")
        .mapInArrow(tidy(_overlaps(width)), "leader long, cls long, leader_n int, n int, both int")
    )


def _tiles(percent: int, most: int | None):
    """Pairs of a tile in different components that the leader's overlaps leave open (sure false) or settle (sure true).

    most: open pairs of a member at most. A tile of which more are left out
    gives its token with neither leader nor class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def one(c: list[np.ndarray]) -> tuple[list[np.ndarray], bool]:
            left, comp, cls, n, pos, lead, lead_n, both = c
            n = n.astype(np.int64)
            rows, cols = (np.flatnonzero(left == 0), np.flatnonzero(left == 1)) if (left == 1).any() else (np.arange(len(cls)),) * 2
            same = not (left == 1).any()
            made = []
            had = np.zeros(len(cols), np.int64)
            cut = False
            for at in range(0, len(rows), 256):
                r = rows[at : at + 256][:, None]
                s = cols[None, :]
                need = (percent * (n[r] + n[s]) + 99 + percent) // (100 + percent)
                open_ = (comp[r] != comp[s]) & (np.minimum(n[r], n[s]) >= need) & (np.minimum(n[r] - pos[r], n[s] - pos[s]) >= need)
                known = (lead[r] == lead[s]) & (both[r] >= 0) & (both[s] >= 0)
                upper = np.minimum(both[s] + n[r] - both[r], both[r] + n[s] - both[s])
                open_ &= ~(known & (upper < need))
                if same:
                    open_ &= r < s
                settled = open_ & known & (both[r] + both[s] - lead_n[r] >= need)
                if most:
                    every = open_
                    open_ = open_ & ~settled
                    open_ &= np.cumsum(open_, axis=1) <= most
                    open_ &= np.cumsum(open_, axis=0) + had <= most
                    had = had + open_.sum(0)
                    open_ |= settled
                    cut = cut or bool((every & ~open_).any())
                i, j = np.nonzero(open_)
                a, b = r[i, 0], s[0, j]
                sure = settled[i, j]
                x, y = np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])
                made.append([x, y, sure])
            return [np.concatenate(z) for z in zip(*made, strict=True)], cut

        def work(cols, last):
            key = cols[:4]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key[:3]], axis=0)) + 1
            begins, ends = np.concatenate([[0], change]), np.concatenate([change, [len(key[0])]])
            stop = len(begins) if last else len(begins) - 1
            parts, cut = [], []
            for k in range(stop):
                pairs, more = one([c[begins[k] : ends[k]] for c in cols[3:]])
                parts.append(pairs)
                if more:
                    cut.append(int(cols[0][begins[k]]))
            x, y, sure = (np.concatenate(z) for z in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
            n, m = len(x), len(cut)
            made = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(cut, pa.int64())]),
                    pa.concat_arrays([pa.array(x), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(y), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(sure.astype(bool)), pa.nulls(m, pa.bool_())]),
                ],
                ["token", "leader", "cls", "sure"],
            )
            return made, None if last else [c[begins[-1] :] for c in cols]

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(rest, cols, strict=True)]
            made, rest = work(cols, False)
            yield made
        if rest is not None:
            yield work(rest, True)[0]

    return run


def _common(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common tokens of told (token, n), ascending, and their counts: COMMON_TOKENS at most.

    The levels of counts, a thousand at most, say above which count so many are left.
    """
    many = told.groupBy("token").agg(F.sum("n").alias("many")).withColumn("level", F.floor(F.log("many") * 32).cast("int"))
    cut, total = None, 0
    for r in sorted(many.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > COMMON_TOKENS:
            break
        cut = r["level"]
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = many.where(F.col("level") >= cut).select("token", "many").toPandas()
    common = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    return common[order], top["many"].to_numpy(np.int64)[order]


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text, any more columns).

    component_id is the smallest doc_id that can be reached by links, the
    row's own included. Null and empty texts have no shingles and link with
    nothing; equal rows link; rows without a doc_id have no component_id. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "jaccard", lean=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    told = scratch.write(docs.mapInArrow(tidy(_describe(width)), "kind int, doc_id long, n int, cls long"), "described")
    meta = told.where("kind = 0").select("doc_id", "n", "cls")
    n_docs = meta.count()
    common, counts = _common(told.where("kind = 1").select(F.col("cls").alias("token"), "n"))
    classes = meta.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    reps = scratch.write(in_tasks(classes, n_docs), "reps")

    index = docs.where("doc_id is not null").select("text").mapInArrow(tidy(_prefixes(width, percent, common, counts)), "token long, salt int, cls long, n int, pos int")
    lists = scratch.write(
        index.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "pos", "cls").mapInArrow(tidy(_lists(percent)), _PAIRS), "lists"
    )
    n_listed = lists.count()
    portions = lists.where("kind = 2")
    heads = portions.groupBy("token").agg(F.min(F.struct("n", "cls")).alias("head")).select("token", F.col("head.cls").alias("leader"))
    bridges = portions.select("token", "cls").join(heads, "token").where("cls <> leader").select("leader", "cls")
    pairs = (
        lists.where("kind = 0").select("leader", "cls").unionByName(bridges)
        .groupBy("leader", "cls").agg(F.lit(1).alias("one")).select("leader", "cls")
    )
    pairs = scratch.write(in_tasks(pairs, n_listed), "pairs")
    n_pairs = pairs.count()
    over = scratch.write(_compare(docs, reps, pairs, n_docs + n_pairs, width, scratch, every=True), "overlaps")
    linked = f"100L * both >= {percent}L * (leader_n + n - both)"

    # from here on nodes are classes
    edge = lambda df: df.select(F.col("leader").alias("u"), F.col("cls").alias("v"))
    comps = connected_components(edge(over.where(linked)), scratch)
    tried = pairs.select(F.least("leader", "cls").alias("leader"), F.greatest("leader", "cls").alias("cls"))
    listed = lists.where("kind = 1").select("token", "cls", "n", "pos", "leader", "leader_n").join(over.select("leader", "cls", "both"), ["leader", "cls"], "left")
    listed = listed.withColumn("both", F.when(F.col("leader") == F.col("cls"), F.col("n")).otherwise(F.coalesce("both", F.lit(-1))))
    listed = scratch.write(in_tasks(listed, n_listed + n_pairs), "listed")
    scratch.drop(lists)
    for most in STEPS:
        members = (
            listed.join(comps.withColumnRenamed("node", "cls"), "cls", "left")
            .withColumn("alone", F.col("component").isNull().cast("int")).withColumn("comp", F.coalesce("component", "cls")).drop("component")
        )
        members = scratch.write(members, "members")
        mixed = (
            members.groupBy("token").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .where("m >= 3 and lo <> hi").select("token", F.ceil(F.col("m") / PORTION).cast("int").alias("tiles"))
        )
        rest = (
            members.join(mixed, "token")
            .withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .select(
                "token", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
                (F.col("tile") > F.col("other")).cast("int").alias("right"), "comp", "cls", "n", "pos", "leader", "leader_n", "both",
            )
        )
        found = (
            rest.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "right", "cls")
            .mapInArrow(tidy(_tiles(percent, most)), "token long, leader long, cls long, sure boolean")
            .groupBy("token", "leader", "cls").agg(F.max("sure").alias("sure"))
        )
        found = scratch.write(in_tasks(found, n_listed), "found")
        n_found = found.count()
        opened = found.where("not sure").join(tried, ["leader", "cls"], "left_anti").select("leader", "cls")
        opened = scratch.write(in_tasks(opened, n_found + n_pairs), "opened")
        n_opened = opened.count()
        more = edge(found.where("sure"))
        if n_opened:
            over = scratch.write(_compare(docs, reps, opened, n_docs + n_opened, width, scratch).where(linked), "links")
            more = more.unionByName(edge(over))
            tried, n_pairs = tried.unionByName(opened), n_pairs + n_opened
        if not more.isEmpty():
            comps = connected_components(more.unionByName(comps.select(F.col("node").alias("u"), F.col("component").alias("v"))), scratch)
        again = found.where("token is not null").select("token")
        scratch.drop(members)
        if again.isEmpty():
            break
        listed = scratch.write(in_tasks(listed.join(again, "token", "left_semi"), n_listed), "listed")
        n_listed = listed.count()
    named = reps.join(comps.withColumnRenamed("node", "cls"), "cls").select("cls", "component", "rep")
    named = scratch.write(in_tasks(named, n_docs), "named")
    least = scratch.write(in_tasks(named.groupBy("component").agg(F.min("rep").alias("least")), n_docs), "least")
    named = scratch.write(in_tasks(named.join(least, "component").select("cls", "least"), n_docs), "classes")
    classes = meta.join(reps, "cls", "left").join(named, "cls", "left")
    return classes.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("least", "rep")).alias("component_id"),
    )
