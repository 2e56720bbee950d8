import random

import numpy as np
from pyspark.sql import functions as F

from reflume.llm import quality, toxicity

WORDS = "the a of and in to is it for on with as at by from that this be are was".split()


def word(rng):
    return "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else word(rng) for _ in range(n)).capitalize() + "."


def corpus(n=500, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        text = prose(rng, rng.randint(5, 300))
        toxic = rng.random() < 0.3
        if toxic:
            parts = text.split(" ")
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), rng.choice(["idiot", "moron", "zuqqi" + word(rng)]))
            text = " ".join(parts)
        good = rng.random() < 0.7
        if not good:
            text = " ".join(w + rng.choice(["%%%", "&&&", "$$$"]) for w in text.split(" "))
        rows.append((k, text, "x"))
        labels.append((k, int(good), int(toxic)))
    return rows, labels


def accuracy(scored, labels, which):
    want = {r[0]: r[which] for r in labels}
    held = [r for r in scored if r.held_out and r.doc_id in want]
    return sum(r.predicted == want[r.doc_id] for r in held) / len(held), len(held)


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (9001, None, None), (9002, "", "y"), (9003, "word " * 100_000, "y"), (9003, "word " * 100_000, "y"), (None, "idiot", "z")], "doc_id long, text string, score string").repartition(3)
    known = spark.createDataFrame([*labels, (9001, None, None), (None, 1, 1), (5, 7, 7), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    for module, which, least in ((toxicity, 2, 0.95), (quality, 1, 0.95)):
        model = module.train(docs, known)
        scored = module.score(docs, model).collect()
        assert len(scored) == len(rows) + 5 and all(0 <= r.score <= 1 for r in scored)
        right, n = accuracy(scored, labels, which)
        assert n > 60 and right >= least
        cut = 0.5 if module is toxicity else 0.3
        assert all(r.predicted == int(r.score >= cut) for r in scored)
        assert {r.score for r in scored if r.doc_id == 9001} == {r.score for r in scored if r.doc_id == 9002}
        again = {str(r) for r in module.score(docs.coalesce(1), module.train(docs, known)).select("doc_id", F.round("score", 6)).collect()}
        assert again == {str(r) for r in module.score(docs, model).select("doc_id", F.round("score", 6)).collect()}
        assert module.score(docs.limit(0), model).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you are an idiot and a moron"), (2, "a calm text"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {1: 1, 2: 0, 3: 0}
    assert quality.train(docs, none) is None and {r.score for r in quality.score(docs, None).collect()} == {0.5}
    kept = toxicity.keep_clean(docs, toxicity.train(docs, none))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_label_model_counts_copies_of_a_voter_once():
    rng = np.random.default_rng(1)
    y = (rng.random(2000) < 0.3).astype(int)
    one = (rng.random(2000) < np.where(y, 0.8, 0.02)).astype(float)
    votes = np.stack([one, one, one, (rng.random(2000) < np.where(y, 0.7, 0.05)).astype(float)], 1)
    gold = np.where(rng.random(2000) < 0.05, 1 - y, y)
    post, rates = toxicity.label_model(votes, gold, np.ones(2000), 0.3)
    assert ((post > 0.5) == y).mean() > 0.97 and abs(rates[1, 3] - 0.7) < 0.08 and abs(rates[0, 0] - 0.02) < 0.03


def test_gradients_of_the_attention_network():
    rng = np.random.default_rng(2)
    counts = np.array([1, 3, 2])
    x, y = rng.normal(size=(6, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    model = quality.fit(x, counts, y, np.ones(3), rounds=200)
    p, a = model.bags(x, counts)
    assert ((p > 0.5) == y).all() and np.allclose(np.add.reduceat(a, [0, 1, 4]), 1)


def test_passages_cover_whole_texts():
    texts = ["", "short", "word " * 2000, "x" * 500_000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    x, counts = quality.passages(data, offsets)
    assert counts.tolist() == [1, 1, 12, 625] and len(x) == counts.sum() and np.isfinite(x).all()


def plain_passages(text: bytes) -> list[list[float]]:
    """The features by their definition, a passage at a time."""
    import re

    n = max(1, len(text) // quality.PASSAGE)
    edges = [len(text) * k // n for k in range(n + 1)]
    words = [(m.start(), bytes(c + 32 if 65 <= c <= 90 else c for c in m.group())) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    threes = [(words[k][0], tuple(w for _, w in words[k : k + 3])) for k in range(len(words) - 2)]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        size = max(b - a, 1)
        row = [sum(c in bytes(kind) for c in text[a:b]) / size for kind in quality._CLASSES.values()]
        mine = [w for at, w in words if a <= at < b]
        row += [len(mine) / size * 6, np.log1p(size / max(len(mine), 1))]
        for items in (words, threes):
            keys = [w for _, w in items]
            here = [w for at, w in items if a <= at < b]
            row.append(sum(keys.count(w) > 1 for w in here) / max(len(here), 1))
        row += [np.log1p(text[a:b].count(b"\n")), np.log1p(size), np.log1p(len(text))]
        out.append(row)
    return out


def plain_score(model, rows):
    """Gated attention by its formula, a passage at a time."""
    w = model.parts
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = [np.tanh(np.clip((np.float32(r).astype(float) - model.mean) / model.scale, -8, 8) @ w["w1"] + w["b1"]) for r in rows]
    e = [np.exp((np.tanh(x @ w["v"]) * sig(x @ w["u"])) @ w["q"]) for x in h]
    z = sum(k * x for k, x in zip(e, h, strict=True)) / sum(e)
    return sig(np.clip(z @ w["c"] + w["d"], -30, 30))[0]


def odd_texts():
    rng = random.Random(8)
    return ["", "a", "a\x0cb c d", "one\x0btwo", *(f"w{chr(c)}x y{chr(c)}" for c in range(32)), prose(rng, 900), "é " * 1500, "same line here\n" * 300, "UPPER lower 12 %%% " * 80]


def test_quality_scores_equal_a_plain_version_alone_and_together(spark):
    rows, labels = corpus(200, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = [*odd_texts(), *(r[1] for r in rows[:20])]
    together = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in quality.score(together, model).collect()}
    for k, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        x, counts = quality.passages(data, np.array([0, len(data)]))
        alone = model.bags(x.astype(np.float32).astype(float), counts)[0][0]
        assert abs(got[k] - alone) < 1e-9 and abs(got[k] - plain_score(model, plain_passages(text.encode()))) < 1e-5, text[:40]


def test_toxicity_scores_equal_a_plain_version(spark):
    import math
    import re

    rows, labels = corpus(300, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = [*odd_texts(), "IDIOT idiots xidiot idiot1 idiot_", "you are such a moron!!! shut up", *(r[1] for r in rows[:60])]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        x, hits = model.weights[-1], 0
        for name, weight in zip(model.names, model.weights, strict=False):
            if name[0] == "#":
                n = int(bool(toxicity.PATTERNS[name].search(text)))
            else:
                end = r"(?![^\W\d_])" if name[0] == "=" else ""
                n = len(re.findall(rf"(?<![^\W\d_])(?={re.escape(name[1:])}{end})", text.lower()))
                hits += n
            x += weight * (n > 0)
        x += model.weights[-2] * math.log1p(hits)
        assert abs(got[k] - 1 / (1 + math.exp(-max(-30, min(30, x))))) < 1e-9, text[:60]


def test_a_label_sample_is_bounded_by_ids(spark):
    from reflume.llm.common import label_sample

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (4, "c")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (4, 0), (4, 1)], "doc_id long, toxic int")
    assert {tuple(r) for r in label_sample(docs, known, "toxic", 10).collect()} <= {(1, "a", 1), (4, "c", 0)}
