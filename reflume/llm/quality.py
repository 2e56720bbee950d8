"""Quality by attention-based multiple-instance learning.

A document is a bag of passages: consecutive cuts of its whole text, of PASSAGE
bytes or a little more each, however long it is. A small network encodes every passage, gated attention
(Ilse et al. 2018) weighs the passages of a bag, and a logistic layer scores the
weighted sum. All of it is learned from document labels: passages have none.

Bounds: MOST_LABELLED documents of each label outside the held-out fold, in
id-hash order; training sees passage features only (FEATURES numbers each), of
at most TRAIN_PASSAGES passages of a document, evenly spaced. Scoring sees all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reflume.llm.common import bound_batches, held_out, label_sample, tidy
from reflume.llm.words import cuts, mix, placed_words

MOST_LABELLED = 3000
PASSAGE = 800
TRAIN_PASSAGES = 256

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "stop": b".?", "comma": b",;:", "bar": b"|", "bang": b"!",
    "sign": b"#$%&*@^~=+<>{}[]\\/_", "quote": b"\"'`()-", "high": range(128, 256),
}
_OF = np.zeros(256, np.int64) + len(_CLASSES)
for _k, _v in enumerate(_CLASSES.values()):
    _OF[list(_v)] = _k
NAMES = [*_CLASSES, "words", "length", "double", "triple", "lines", "size", "bag"]
FEATURES = len(NAMES)


def _share_seen(owner: np.ndarray, key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each of n passages, the share of its keys that occur more than once in its document."""
    if not len(key):
        return np.zeros(n)
    with np.errstate(over="ignore"):
        whole = mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, counts = np.unique(whole, return_inverse=True, return_counts=True)
    many = np.bincount(owner, weights=counts[inverse] > 1, minlength=n)
    return many / np.maximum(np.bincount(owner, minlength=n), 1)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages, FEATURES) of all rows of a cut, and the number of passages of each row (1 at least)."""
    sizes = np.diff(offsets)
    counts = np.maximum(sizes // PASSAGE, 1)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[row] + sizes[row] * nth // counts[row]
    ends = np.append(starts[1:], offsets[-1])
    n, length = len(row), np.maximum(ends - starts, 1).astype(float)
    x = np.zeros((n, FEATURES))
    at = np.repeat(np.arange(n), ends - starts)
    kinds = len(_CLASSES) + 1
    x[:, : len(_CLASSES)] = np.bincount(at * kinds + _OF[data], minlength=n * kinds).reshape(n, kinds)[:, :-1] / length[:, None]
    where, hashes, bounds = placed_words(data, offsets)
    word_at = at[where]
    words = np.bincount(word_at, minlength=n)
    x[:, len(_CLASSES)] = words / length * 6
    x[:, len(_CLASSES) + 1] = np.log1p(length / np.maximum(words, 1))
    if len(hashes):
        doc = np.repeat(np.arange(len(sizes)), np.diff(bounds))
        x[:, len(_CLASSES) + 2] = _share_seen(word_at, hashes, doc, n)
        with np.errstate(over="ignore"):
            three = hashes[:-2] + hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(7) if len(hashes) > 2 else hashes[:0]
        same = doc[:-2] == doc[2:] if len(hashes) > 2 else np.zeros(0, bool)
        x[:, len(_CLASSES) + 3] = _share_seen(word_at[:-2][same] if len(hashes) > 2 else word_at[:0], three[same], doc[:-2][same] if len(hashes) > 2 else doc[:0], n)
    x[:, len(_CLASSES) + 4] = np.log1p(np.bincount(at[data == 10], minlength=n))
    x[:, len(_CLASSES) + 5] = np.log1p(length)
    x[:, len(_CLASSES) + 6] = np.log1p(sizes[row])
    return x, counts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag, and the attention weight of each passage."""
        out = forward(self.parts, np.clip((x - self.mean) / self.scale, -8, 8), counts)
        return out["p"], out["a"]


def forward(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    first = np.cumsum(counts) - counts
    bag = np.repeat(np.arange(len(counts)), counts)
    h = np.tanh(x @ w["w1"] + w["b1"])
    v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    s = (v * u) @ w["q"]
    e = np.exp(s - np.maximum.reduceat(s, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return {"h": h, "v": v, "u": u, "a": a, "z": z, "p": p, "bag": bag, "first": first}


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 400, seed: int = 5) -> Model:
    """Adam on the weighted log loss, all bags at each step."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8)
    d = x.shape[1]
    w = {
        "w1": rng.normal(size=(d, hidden)) / np.sqrt(d), "b1": np.zeros(hidden), "v": rng.normal(size=(hidden, gate)) / np.sqrt(hidden), "u": rng.normal(size=(hidden, gate)) / np.sqrt(hidden),
        "q": rng.normal(size=gate) / np.sqrt(gate), "c": rng.normal(size=hidden) / np.sqrt(hidden), "d": np.zeros(1),
    }
    weight = weight / weight.sum()
    slow, fast = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for t in range(1, rounds + 1):
        o = forward(w, x, counts)
        g = weight * (o["p"] - y)
        dz = g[:, None] * w["c"]
        da = (o["h"] * dz[o["bag"]]).sum(1)
        ds = o["a"] * (da - np.add.reduceat(o["a"] * da, o["first"])[o["bag"]])
        dv, du = ds[:, None] * w["q"] * o["u"] * (1 - o["v"] ** 2), ds[:, None] * w["q"] * o["v"] * o["u"] * (1 - o["u"])
        dh = (o["a"][:, None] * dz[o["bag"]] + dv @ w["v"].T + du @ w["u"].T) * (1 - o["h"] ** 2)
        grad = {"w1": x.T @ dh, "b1": dh.sum(0), "v": o["h"].T @ dv, "u": o["h"].T @ du, "q": (o["v"] * o["u"]).T @ ds, "c": o["z"].T @ g, "d": np.array([g.sum()])}
        for k in w:
            grad[k] = grad[k] + (1e-4 * w[k] if k not in ("b1", "d") else 0)
            slow[k] = 0.9 * slow[k] + 0.1 * grad[k]
            fast[k] = 0.99 * fast[k] + 0.01 * grad[k] ** 2
            w[k] = w[k] - 0.02 * (slow[k] / (1 - 0.9**t)) / (np.sqrt(fast[k] / (1 - 0.99**t)) + 1e-8)
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """Fits the model on documents labelled in labels.quality, outside the held-out fold; None where a label is missing altogether."""
    bound_batches(docs.sparkSession)
    share = labels.where(F.col("quality").isin(0, 1) & ~held_out()).agg(F.avg(F.col("quality").cast("double"))).first()[0]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in cuts(batch.column(1)):
                x, counts = passages(data, offsets)
                ends = np.cumsum(counts)
                used = np.minimum(counts, TRAIN_PASSAGES)
                rows = [x[e - c + np.arange(k) * c // k].astype(np.float32).tobytes() for e, c, k in zip(ends, counts, used, strict=True)]
                part, counts = batch.slice(first, len(counts)), used
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts.astype(np.int32)), pa.array(rows, pa.binary())], ["doc_id", "y", "n", "x"])

    told = label_sample(docs, labels, "quality", most).mapInArrow(tidy(features), "doc_id long, y int, n int, x binary").toPandas().sort_values(["doc_id", "x"])
    if share is None or told["y"].nunique() < 2:
        return None
    x = np.vstack([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in told["x"]]).astype(float)
    y = told["y"].to_numpy(float)
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    return fit(x, told["n"].to_numpy(np.int64), y, weight)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, top_attention of every row of docs (doc_id, text, any more columns).

    Null and empty texts are one empty passage. Without a model every score is 0.5.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in cuts(batch.column(1)):
                x, counts = passages(data, offsets)
                x = x.astype(np.float32).astype(float)
                p, a = model.bags(x, counts) if model else (np.full(len(counts), 0.5), np.ones(int(counts.sum())) / np.repeat(counts, counts))
                top = np.maximum.reduceat(a, np.cumsum(counts) - counts)
                p = p.round(12)  # sums over other numbers of rows may differ in the last bits
                ids = batch.column(0).slice(first, len(counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(p), pa.array(counts.astype(np.int64)), pa.array(top)], ["doc_id", "score", "n_passages", "top_attention"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double, n_passages long, top_attention double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "top_attention")
