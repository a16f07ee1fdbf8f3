import hashlib
import itertools

import numpy as np
from pyspark.sql import functions as F

from tradelens.llm import hilbert
from tradelens.llm.common import read

SHAPE = "vec_id long, embedding array<double>"


def brute(rows, k=40, rounds=5):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    m = np.stack([v for _, v in kept])
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"2:{kept[j][0]}".encode()).hexdigest(), kept[j][1].tolist()))
    c = m[order[:k]].copy()

    def assign():
        d = np.stack([((m - x) ** 2).sum(1) for x in c], axis=1)
        best = d.argmin(1)
        return best, d[np.arange(len(m)), best]

    for _ in range(rounds):
        best, _d = assign()
        for j in range(len(c)):
            if (best == j).any():
                c[j] = m[best == j].sum(0) // (best == j).sum()
    best, d = assign()
    out = [(kept[i][0], int(j), int(d[i]), int(d[best == j].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for i, j in enumerate(best)]
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, hilbert.cluster(df).collect()), key=repr)


def test_whole_table_is_the_brute_force(spark):
    df = read(spark, "/root/testdata/sf0.01", "embeddings")
    assert result(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_vectors_take_no_part_and_copies_count(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 64)) * 3
    rows = [(i, (base[i % 6] + rng.normal(size=64) * 0.05).tolist()) for i in range(300)]
    rows += [(1000 + i, base[0].tolist()) for i in range(200)] + [rows[0], rows[0], (None, base[1].tolist())]
    odd = [(1, None), (2, []), (3, base[0][:63].tolist()), (4, [None, *base[0][1:].tolist()]), (5, [float("nan"), *base[0][1:].tolist()]), (6, [float("inf"), *base[0][1:].tolist()])]
    df = spark.createDataFrame(rows + odd, SHAPE)
    want = brute(rows)
    assert result(df) == want
    assert result(df.withColumn("place", F.lit("x")).withColumn("v", F.lit(1)).withColumn("cluster", F.lit(2))) == want


def test_large_components_and_few_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * 1e5).tolist()) for i in range(60)]
    assert result(spark.createDataFrame(rows, SHAPE)) == brute(rows)
    assert result(spark.createDataFrame(rows[:3], SHAPE)) == brute(rows[:3])
    assert result(spark.createDataFrame([(1, [1e9] * 64)], SHAPE)) == []
    assert result(spark.createDataFrame([], SHAPE)) == []


def test_the_curve_visits_neighbouring_cells():
    """In two and three dimensions every cell once, each a unit step from the one before."""
    for d, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(2**bits), repeat=d)))
        keys = hilbert.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_boxes_exclude_centroids_only_where_they_cannot_win():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-400, 400, (40, 64))
    for _ in range(50):
        m = centroids[rng.integers(40)] + rng.integers(-20, 20, (30, 64))
        may = hilbert.candidates(m.min(0)[None], m.max(0)[None], centroids)[0]
        assert may[hilbert.nearest(m, centroids)[0]].all()
        assert may.sum() < 40
