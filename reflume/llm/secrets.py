"""Secret scans with DataFrame functions only.

Three patterns find what looks like a secret by form. Beside them, two Markov
models of character pairs, one of random strings and one of ordinary
identifiers, score every run of 16 or more token characters by their
log-likelihood ratio; runs that are more likely random are spans of kind
`random`, unless a pattern's span overlaps them.

Offsets come without a Python function: the text between matches (split) and
the matches themselves (regexp_extract_all) follow each other, so their lengths
add up to the positions, in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reflume.llm.common import free_name

#: The patterns, the least length of what they must match, in the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ASSIGN_FIRST = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""  # how every match of ASSIGN begins
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more; a longer run has no other match in it
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "random")

RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: A run counts as random above this log-likelihood ratio, in all and by character pair.
LEAST_RATIO, LEAST_MEAN = 6.0, 0.25


def _spans(text: Column, pattern: str, least: int = 0) -> Column:
    """(start, end, match) of all matches, in order; least: of the second group's length."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    last = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else found
    rows = F.arrays_zip(
        F.transform(F.slice(pieces, F.lit(1), F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("n"), found.alias("match"),
        F.transform(last, F.length).alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.array(F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["match"].alias("match")))
        return F.struct((begin + x["n"]).alias("at"), F.when(x["value"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def samples(docs: DataFrame, documents: int = 200, strings: int = 3000) -> DataFrame:
    """Labelled samples (sample, label): `strings` random strings of each of three alphabets, and the identifiers of `documents` documents.

    The documents are the first in the order of a hash of their ids; their words
    count as they stand, joined by underscores, and run together in title case.
    What a pattern matches is taken out before.
    """
    spark = docs.sparkSession
    raw = spark.range(strings).select(F.unhex(F.sha2(F.concat(F.lit("s"), F.col("id").cast("string")), 512)).alias("b"))
    wide = F.regexp_replace(F.base64("b"), r"\s", "")
    random = raw.select(
        F.explode(F.array(F.substring(wide, 1, 40), F.lower(F.substring(F.hex("b"), 1, 40)), F.substring(F.upper(F.regexp_replace(wide, "[^A-Za-z0-9]", "")), 1, 24))).alias("sample"),
        F.lit(1).alias("label"),
    )
    ids = docs.where("doc_id is not null and text is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    plain = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    words = docs.join(F.broadcast(ids), "doc_id").select(F.filter(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9+/_=-]+"), F.lit(0)), lambda w: F.length(w) >= 2).alias("w"))
    pair = lambda i, join, f: F.concat(f(F.col("w")[i]), F.lit(join), f(F.col("w")[i + 1]))
    steps = F.sequence(F.lit(0), F.size("w") - 2)
    ordinary = words.where(F.size("w") >= 2).select(
        F.explode(F.concat(F.col("w"), F.transform(steps, lambda i: pair(i, "_", lambda x: x)), F.transform(steps, lambda i: pair(i, "", F.initcap)))).alias("sample"), F.lit(0).alias("label")
    )
    return random.unionByName(ordinary)


def train(labelled: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of the 128 x 128 pairs of ASCII characters, random over ordinary.

    labelled: sample, label (1 random, 0 ordinary). Null samples and other
    labels are left out. The counts that reach the driver are 2 x 128 x 128 at most.
    """
    codes = labelled.where("sample is not null and label in (0, 1)").select("label", F.transform(F.filter(F.split("sample", ""), lambda c: c != ""), F.ascii).alias("c"))
    pairs = codes.where(F.size("c") >= 2).select("label", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * 128 + b)).alias("p"))
    counts = pairs.where("p >= 0 and p < 16384").groupBy("label", "p").count().collect()
    letters = sorted({ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"})
    logs = []
    for label in (0, 1):
        n = {r.p: r["count"] for r in counts if r.label == label}
        total = {a: sum(n.get(a * 128 + b, 0) for b in letters) for a in letters}
        logs.append({a * 128 + b: math.log((n.get(a * 128 + b, 0) + smooth) / (total[a] + smooth * len(letters))) for a in letters for b in letters})
    return [round(logs[1][k] - logs[0][k], 6) if k in logs[0] else 0.0 for k in range(128 * 128)]


def _random(text: Column, model: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{x:g}" for x in model)), ",").cast("array<double>")
    score = lambda run: F.aggregate(
        F.transform(F.split(run, ""), F.ascii), F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("before"), (acc["sum"] + F.when((acc["before"] <= 0) | (c <= 0), 0.0).otherwise(F.element_at(table, acc["before"] * 128 + c + 1))).alias("sum")),
        lambda acc: acc["sum"],
    )
    scored = F.transform(_spans(text, RUN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), score(s["match"]).alias("ratio")))
    return F.filter(scored, lambda s: (s["ratio"] >= LEAST_RATIO) & (s["ratio"] >= LEAST_MEAN * (s["end"] - s["start"] - 1)))


def scan(docs: DataFrame, model: list[float], name: str = "secrets") -> DataFrame:
    """docs with a column `name`: array of (start, kind, end), kind an index of KINDS, by start and kind.

    Null texts count as empty. A column of that name is replaced.
    """
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    text = F.coalesce(F.col("text"), F.lit(""))
    typed = lambda name, kind: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    assign, access, hexes, random, base = names = [free_name(docs, f"_{x}") for x in ("assign", "access", "hex", "random", "base")]
    none = F.array().cast("array<struct<start:int,end:int,match:string,ratio:double>>")
    # the first test of each kind is one pass that most texts fail
    found = docs.withColumns({
        assign: F.when(text.rlike(ASSIGN_FIRST), _spans(text, ASSIGN, ASSIGN_LEAST)).otherwise(empty),
        access: F.when(text.contains("AKIA"), _spans(text, ACCESS)).otherwise(empty),
        hexes: F.when(text.rlike("[0-9a-f]{16}"), _spans(text, HEX)).otherwise(empty),
        random: F.when(text.rlike("[A-Za-z0-9+/_=-]{16}"), _random(text, model)).otherwise(none),
    })
    found = found.withColumn(base, F.concat(typed(assign, 0), typed(access, 1), typed(hexes, 2)))
    free = F.filter(typed(random, 3), lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return found.withColumn(name, F.array_sort(F.concat(base, free))).drop(*names)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row of docs (doc_id, text, any more columns)."""
    model = train(samples(docs)) if model is None else model
    found = scan(docs.select("doc_id", "text"), model).select("doc_id", "secrets", F.filter("secrets", lambda s: s["kind"] < 3).alias("base"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, model: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span in text replaced by `mark`; overlapping spans by one. Null texts stay null, other columns as they are."""
    model = train(samples(docs)) if model is None else model
    spans, done = free_name(docs, "_secrets"), free_name(docs, "_done")
    found = scan(docs, model, spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], before, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    found = found.withColumn(done, F.when(F.size(spans) > 0, F.aggregate(spans, start, step)))
    rest = F.substring(F.col("text"), F.col(f"{done}.at") + 1, F.length("text"))
    text = F.when(F.col(done).isNull(), F.col("text")).otherwise(F.concat(F.col(f"{done}.out"), rest))
    return found.withColumn("text", text).drop(done, spans)
