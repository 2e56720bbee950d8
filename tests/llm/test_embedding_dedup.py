import numpy as np
import pytest

from reflume.llm.embedding_dedup import cosine_components


def brute(rows, threshold=0.93):
    ok = [label is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0) for _, v, label in rows]
    up = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted((r[0], links[i], low[root(i)], r[0] == low[root(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("tile", [1024, 8])
def test_equals_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        label = int(rng.integers(0, 3))
        if rows and rng.random() < 0.5:
            old = rows[rng.integers(len(rows))]
            rows.append((k, [float(np.float32(x)) for x in np.array(old[1]) + rng.normal(size=16) * rng.choice([0, 0.03])], old[2]))
        else:
            rows.append((k, [float(np.float32(x)) for x in rng.normal(size=16)], label))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, rows[0][1], None), (203, [1.0, None], 1), (204, [float("nan")] * 16, 1), (205, [float("inf")] * 16, 1), (206, [], 1), (207, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "vec_id long, embedding array<double>, label int, rep int").withColumn("embedding", __import__("pyspark").sql.functions.col("embedding").cast("array<float>"))
    want = brute(rows)
    got = sorted(tuple(r) for r in cosine_components(df, tile=tile).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    pairs = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.97 * pairs and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= len(want) - 3


def test_empty_and_repeats(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert cosine_components(spark.createDataFrame([], schema)).collect() == []
    got = cosine_components(spark.createDataFrame([(3, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (1, [2.0, 4.0], 0), (None, [1.0, 2.0], 0)], schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, 2, 1, False), (3, 2, 1, False), (1, 2, 1, True), (None, 0, None, None)], key=str)
