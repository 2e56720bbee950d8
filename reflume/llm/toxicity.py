"""Toxicity by weak supervision.

Many voters look at a text: words and word beginnings of a lexicon, part of it
given and part mined from the labelled sample, and a few patterns. A generative
label model (a mixture over the hidden label, fitted by EM) estimates how often
each voter fires on toxic and on clean texts, and how voters are correlated
given the label; correlated voters share one voice. The annotators' label is one
more, imperfect voter of that model, silent on documents that have none: those
count too, half as much as the labelled ones together. Its posterior on the
labelled documents trains a linear classifier that sees the texts' votes only,
never labels, lang, source or doc_id.

Bounds: MOST_LABELLED documents of each label, and as many without a label, all
outside the held-out fold, in id-hash order, and MOST_VOTERS mined voters. Near copies count once when voters
are mined (one document for each smallest 3-word shingle), so that the words of
a text copied a thousand times do not look like evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reflume.llm.common import Scratch, bound_batches, held_out, label_sample, tidy
from reflume.llm.words import shingle_sets

MOST_LABELLED = 4000
MOST_VOTERS = 512

#: Insults that vote from the start. = is a whole word, ^ the beginning of one.
LEXICON = (
    "=idiot =idiots =moron =morons =stupid =trash =scum =clown =worthless =pathetic =disgusting =loser =losers =dumb "
    "=dumbass =bastard =bitch =asshole =shithead =imbecile =retard =vermin =filth =subhuman =idiota =estúpido =imbécil =basura "
    "=connard =salaud =ordure =dummkopf =arschloch =abschaum =wertlos"
).split()
PATTERNS = {
    "#frame": re.compile(r"\byou(?:'re| are) (?:such |all |just )?(?:an?|the) \w+", re.I),
    "#shout": re.compile(r"(?:\b[A-Z]{4,}\b[ ,.!]*){3}"),
    "#bang": re.compile(r"!{3,}"),
    "#threat": re.compile(r"\b(?:shut up|go away and die|kill yourself|i(?:'ll| will) (?:kill|hurt) you)\b", re.I),
}
_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)


def terms(text: str) -> set[str]:
    """What a text could be found by: =word and ^beginning."""
    words = set(_WORD.findall(text.lower()))
    return {f"={w}" for w in words if 3 <= len(w) <= 40} | {f"^{w[:n]}" for n in BEGINNINGS for w in words if len(w) > n}


class Voters:
    """Finds all voters of a text in one pass of an automaton."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.names = names
        self.machine = ahocorasick.Automaton()
        self.by_word: dict[str, list[tuple[int, bool]]] = {}
        for k, name in enumerate(names):
            if name[0] in "=^":
                self.by_word.setdefault(name[1:], []).append((k, name[0] == "="))
        for word, who in self.by_word.items():
            self.machine.add_word(word, (len(word), who))
        if self.by_word:
            self.machine.make_automaton()
        self.patterns = [(k, PATTERNS[name]) for k, name in enumerate(names) if name in PATTERNS]

    def fired(self, text: str) -> Counter:
        out: Counter = Counter()
        if self.by_word:
            low = text.lower()
            for end, (n, who) in self.machine.iter(low):
                if end >= n and low[end - n].isalpha():
                    continue
                tail = end + 1 < len(low) and low[end + 1].isalpha()
                for k, whole in who:
                    if not (whole and tail):
                        out[k] += 1
        for k, pattern in self.patterns:
            if pattern.search(text):
                out[k] += 1
        return out


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray  # one a voter, then of log(1 + lexicon hits), then the constant
    accuracy: np.ndarray  # (2, voters): how often a voter fires on clean and on toxic texts

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_voters"}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not hasattr(self, "_voters"):  # once a worker's task, not once a batch
            self._voters = Voters(self.names)
        voters = self._voters
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            hits = voters.fired(text or "")
            x = self.weights[-1] + sum(self.weights[k] for k in hits)
            x += self.weights[-2] * math.log1p(sum(n for k, n in hits.items() if self.names[k][0] != "#"))
            out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
        return out


def label_model(votes: np.ndarray, gold: np.ndarray, weight: np.ndarray, share: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the hidden label, and firing rates (2, voters).

    votes (n, m) 0/1, gold (n) the annotators' 0/1, or -1 where they are silent.
    The first guess is the annotators'; after that their vote has estimated
    error rates like any other, and documents without it count.
    """
    told = gold >= 0
    all_votes = np.hstack([votes, (gold == 1)[:, None]]).astype(float)
    voiced = np.ones(all_votes.shape)
    voiced[:, -1] = told
    post = np.where(gold == 1, 0.9, share * 0.1)
    tied = np.zeros((all_votes.shape[1],) * 2)
    for y in (0, 1):
        # given the annotators' label; a blurred posterior would leave the label itself in these
        w = np.where(gold == y, weight, 0)
        spread = (all_votes - w @ all_votes / max(w.sum(), 1e-9)) * np.sqrt(w)[:, None]
        cov = spread.T @ spread / max(w.sum(), 1e-9)
        sd = np.sqrt(np.diag(cov)) + 1e-6
        tied = np.maximum(tied, cov / sd[:, None] / sd[None, :])
    np.fill_diagonal(tied, 1.0)
    alone = 1 / np.where(tied > 0.3, np.minimum(tied, 1.0), 0).sum(1)  # voters that always fire together count as one
    rates = np.zeros((2, all_votes.shape[1]))
    for k in range(rounds):
        counted = weight * told if k == 0 else weight
        for y in (0, 1):
            w = counted * (post if y else 1 - post)
            rates[y] = (w @ all_votes + (0.2 if y else 0.02)) / (w @ voiced + 0.5)
        fire = np.log(rates[1]) - np.log(rates[0])
        still = np.log1p(-np.clip(rates[1], 0, 0.999)) - np.log1p(-np.clip(rates[0], 0, 0.999))
        z = math.log(share / (1 - share)) + all_votes @ (alone * fire) + (voiced - all_votes) @ (alone * still)
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, rates[:, :-1]


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, rounds: int = 40) -> np.ndarray:
    """Weighted logistic regression on soft labels by Newton steps; the last column of x is constant and not shrunk."""
    out = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge * weight.sum() / 100)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (weight * (y - p)) - pull * out)
        out = out + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return out


def _one_of_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lowest = [int(s[0]) - 2**63 if len(s) else 0 for s in shingle_sets(batch.column(1), 3)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lowest, pa.int64())], ["doc_id", "text", "y", "low"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[1] for c in counts.values()], pa.int32()), pa.array([c[0] for c in counts.values()], pa.int32())], ["term", "toxic", "clean"])

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term in terms(text or ""):
                counts.setdefault(term, [0, 0])[y] += 1
        if len(counts) > 500_000:
            yield told()
            counts.clear()
    yield told()


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, voters: int = MOST_VOTERS) -> Model:
    """Fits the model on documents labelled in labels.toxic, outside the held-out fold.

    Null, other or missing labels are left out; without toxic labels the
    lexicon alone votes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "toxicity")
    share = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    picked = label_sample(docs, labels, "toxic", most, others=most).mapInArrow(tidy(_one_of_copies), "doc_id long, text string, y int, low long")
    first = picked.groupBy("y", "low").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    picked = scratch.write(first.select("first.text", "y", "first.doc_id"), "sample")
    sizes = {r.y: r["count"] for r in picked.groupBy("y").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    names = [*LEXICON, *PATTERNS]
    if toxic and clean:
        base = toxic / (toxic + clean)
        counted = picked.where("y >= 0").select("text", "y").mapInArrow(tidy(_count_terms), "term string, toxic int, clean int").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        rate = (F.col("t") + 0.0) / (F.col("t") + F.col("c"))
        # the gain in log-likelihood over the base rate; what chance would give the best of a million terms is left out
        gain = F.col("t") * F.log(rate / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
        mined = counted.where("t >= 3").withColumn("rate", rate).where("rate >= 0.85").withColumn("gain", gain).where(f"gain >= {math.log(1e6)}").orderBy(F.desc("gain"), "term").limit(voters).collect()
        names += [r.term for r in mined if r.term not in LEXICON]
    if not toxic or not clean:
        weights = np.array([5.0 if n[0] != "#" else 0.0 for n in names] + [0.0, -4.0])
        return Model(names, weights, np.tile([[0.01], [0.5]], len(names)))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Voters(names)
        for batch in batches:
            hits = [finder.fired(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([list(h) for h in hits], pa.list_(pa.int32())), pa.array([sum(n for k, n in h.items() if names[k][0] != "#") for h in hits], pa.int32()), batch.column(2)], ["y", "who", "n", "doc_id"])

    told = picked.mapInArrow(tidy(votes), "y int, who array<int>, n int, doc_id long").toPandas().sort_values("doc_id")  # at most 3 * most rows
    matrix = np.zeros((len(told), len(names)), np.float64)
    for i, who in enumerate(told["who"]):
        matrix[i, who] = 1
    gold = told["y"].to_numpy()
    share = min(max(share, 1e-3), 1 - 1e-3)
    ones, zeros, rest = ((gold == y).sum() for y in (1, 0, -1))
    # the labelled in the shares that labels have, the others half as much in all
    weight = np.select([gold == 1, gold == 0], [share / max(ones, 1), (1 - share) / max(zeros, 1)], 0.5 / max(rest, 1)) * (ones + zeros)
    post, rates = label_model(matrix, gold, weight, share)
    x = np.hstack([matrix, np.log1p(told["n"].to_numpy(float))[:, None], np.ones((len(told), 1))])
    return Model(names, fit_linear(x, post, weight * (gold >= 0)), rates)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text, any more columns).

    Null texts are scored as empty ones; a null doc_id is not held out.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score at the threshold or above; order of columns and types unchanged."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("text") if at is None else at
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
