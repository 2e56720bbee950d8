import random
import re

import numpy as np

from reflume.llm.mixing import mix, plan, split_quotas, targets


def wanted(rows, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by the rule as it stands: share, cut, share the excess again."""
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    z = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    t = dict.fromkeys(names, 0.0)
    left, free = share * sum(size), set(names)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in list(free):
            t[s] += left * w[s] / total
        left = sum(max(0, t[s] - cap * z[s]) for s in names)
        for s in list(free):
            if t[s] >= cap * z[s]:
                t[s] = cap * z[s]
                free.discard(s)
    return size, z, t


def test_plan_meets_targets(spark):
    rng = random.Random(3)
    rows = [(k, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "a", "B", "c", "d", None, "Z"])) for k in range(900)]
    rows += [(2000, None, "a"), (2001, "", "c"), (2002, "only", "tiny"), (2003, None, "nothing"), (2004, "same", "a"), (2004, "same", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as block", "3 as key")
    got = plan(df, shards=8, block_words=200).collect()
    size, z, t = wanted(rows)
    assert sorted((r.doc_id, r.size) for r in got) == sorted((k[0], n) for k, n in zip(rows, size, strict=True))
    source = {k: s for k, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == z[s] and abs(r.target - t[s]) < 1e-6
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size and len(r.shards) * r.size == r.taken
        assert all(0 <= x < 8 for x in r.shards)
        taken[s] = taken.get(s, 0) + r.taken
    for s in z:
        assert abs(taken[s] - t[s]) <= 60
    again = plan(df.repartition(5), shards=8, block_words=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_tree_is_exact_and_even():
    quotas = np.array([700, 0, 31, 5, 1])
    dealt = split_quotas(quotas, 12, 9)
    assert (dealt.sum(0) == quotas).all() and dealt.sum(1).max() - dealt.sum(1).min() <= 1
    assert (dealt == split_quotas(quotas, 12, 9)).all()


def test_targets_reshare_excess():
    assert targets([10, 100, 1000], [5, 2, 1], 1665, 2.0) == [20.0, 200.0, 1445.0]
    assert targets([0, 10], [5, 2], 15, 2.0) == [0.0, 15.0]


def test_mix_and_empty(spark):
    rows = [(k, "a b c d", f"s{k % 3}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(df, shards=4, block_words=8)
    assert set(out.columns) == {"doc_id", "text", "source", "copy", "shard"}
    assert out.count() == sum(len(r.shards) for r in plan(df, shards=4, block_words=8).collect())
    assert plan(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, "a b", "s"), (7, "a b", "s"), (7, "a b", "s"), (7, "c d e", None), (8, None, "s")], "doc_id long, text string, source string")
    mixed, planned = mix(odd, shards=2).collect(), plan(odd, shards=2).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == sum(r.taken for r in planned)
    assert mix(odd.limit(0)).collect() == []
    assert [tuple(r)[:2] for r in plan(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [(1, 0)]


def test_columns_of_any_name_stay(spark):
    rows = [(k, f"a b {k}", "s", k, [k], "x", "y") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k long, shards array<long>, size string, _k string")
    out = mix(df, shards=2)
    assert set(out.columns) == {*df.columns, "copy", "shard"}
    got = out.collect()
    assert got and all(r.k == r.doc_id and r.shards == [r.doc_id] and (r.size, r._k) == ("x", "y") for r in got)
