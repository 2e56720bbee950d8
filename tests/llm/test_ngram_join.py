import random

import pytest
from pyspark.sql import functions as F

from reflume.llm.common import FREE_SHUFFLES, Scratch
from reflume.llm.ngram_join import jaccard_components


def brute(rows, width=5, percent=80):
    import re

    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), k), k)
    return sorted((k, len(sets[i]), low[root(i)]) for i, (k, _) in enumerate(rows))


def made(seed, n=90):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st".split()) + rng.choice("uvwxyz")
    rows = []
    common = [word() for _ in range(60)]
    for k in range(n):
        kind = rng.random()
        if rows and kind < 0.5:  # a chain of near copies
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = word()
            rows.append((k * 3 + 1, " ".join(words)))
        elif kind < 0.7:
            rows.append((k * 3 + 1, " ".join(common + [word() for _ in range(rng.randint(1, 200))])))
        else:
            rows.append((k * 3 + 1, "\n".join(word() for _ in range(rng.randint(0, 120)))))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_equals_brute_force(spark, seed, monkeypatch):
    import reflume.llm.ngram_join as m

    monkeypatch.setattr(m, "PORTION", 8)
    rows = made(seed) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "one two three")]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'z' as cls", "1 as n", "2 as token")
    got = sorted(tuple(r) for r in jaccard_components(df.repartition(3)).collect())
    assert got == brute(rows)


def test_empty_table_repeats_and_null_ids(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f"), (9, "é b c d e f")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 2, 5), (5, 2, 5), (None, 2, None), (7, 2, 5), (9, 2, 9)], key=str)


def test_one_text_longer_than_a_cut(spark):
    text = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, text), (2, text + " end"), (3, "x" * 3_000_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (399_996, 1), 2: (399_997, 1), 3: (1, 3)}


def test_a_lean_step_leaves_no_shuffle_files(spark):
    import time

    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before, scratch = held.size(), Scratch(spark, "test", lean=True)
    df = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    assert scratch.write(df).count() == 7
    late = time.monotonic() + 10
    while held.size() > before + 1 and time.monotonic() < late:  # the count above shuffles once itself
        time.sleep(0.1)
    assert held.size() <= before + 1 and spark.conf.get(FREE_SHUFFLES, None) != "true"
