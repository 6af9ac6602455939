from collections import Counter

import numpy as np
import pytest

from codesieve.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, copies long, home long, vector string"


def brute(rows, t=0.95):
    ok = [i for i, (_, e) in enumerate(rows) if e is not None and None not in e and np.isfinite(e).all() and np.any(np.array(e))]
    unit = {i: np.array(rows[i][1], np.float64) / np.linalg.norm(np.array(rows[i][1], np.float64)) for i in ok}
    label, links = list(range(len(rows))), [0] * len(rows)
    pairs = [(i, j) for x, i in enumerate(ok) for j in ok[:x] if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    low = {}
    for (d, _), k in zip(rows, label):
        if d is not None:
            low[k] = min(low.get(k, d), d)
    return Counter((d, n, low.get(k), d == low.get(k)) for (d, _), n, k in zip(rows, links, label))


def data(seed=5, n=500, d=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    for i in range(n // 3):  # near copies at all angles around the threshold, and exact ones
        x[r.integers(n)] = x[r.integers(n)] * np.float32(r.uniform(0.5, 2)) + r.normal(size=d).astype(np.float32) * np.float32(r.uniform(0, 0.5))
    x[40:60] = x[3] + r.normal(size=(20, d)).astype(np.float32) * np.float32(0.1)
    x[70:75] = x[71]
    rows = [(i * 3 % n, [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * d), (9003, [float("nan")] * d), (9004, [1.0, None] + [0.0] * (d - 2)), (9005, []),
             (9006, [float("inf")] + [1.0] * (d - 1)), (None, rows[71][1]), (None, [5.0] * d), (9007, [1.0, 2.0]), (9008, [2.0, 4.0]),
             (9009, [-0.0, 1.0]), (9010, [0.0, 1.0]), rows[5], rows[5], (9011, [1e30] * d), (9012, [1e-30] * d)]
    return rows


@pytest.mark.parametrize("cell_rows,block_rows", [(4096, 2048), (40, 2048), (60, 16)])
def test_matches_brute_force(spark, cell_rows, block_rows):
    rows = data()
    df = spark.createDataFrame([(i, e, 1, 2, 3, "z") for i, e in rows], SCHEMA).repartition(4)
    got = vectors.embedding_groups(df, cell_rows=cell_rows, block_rows=block_rows).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute(rows)


def test_nothing_usable(spark):
    df = spark.createDataFrame([(1, None, 1, 2, 3, "z"), (2, [0.0], 1, 2, 3, "z")], SCHEMA)
    got = vectors.embedding_groups(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter([(1, 0, 1, True), (2, 0, 2, True)])
    assert vectors.embedding_groups(df.limit(0)).count() == 0
