import numpy as np
from pyspark.sql import functions as F

from tradelens.llm import kmeans_tree
from tradelens.llm.common import read

SHAPE = "vec_id long, embedding array<double>"


def brute(rows, k=5):
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    norm, out = np.sqrt((m * m).sum(1)), []
    for i in np.flatnonzero(ids % 50 == 0):
        score = (m * m[i]).sum(1) / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), n + 1, int(ids[j]), float(score[j])) for n, j in enumerate(order)]
    return sorted(out)


def result(df, **settings):
    return sorted(map(tuple, kmeans_tree.nearest(df, F.col("vec_id") % 50 == 0, settings=kmeans_tree.Settings(**settings)).collect()))


def test_recall_on_the_whole_table(spark):
    df = read(spark, "/root/testdata/sf0.1", "embeddings")
    got, want = result(df), brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert len(got) == len(want)
    score = {(w[0], w[2]): w[3] for w in want}
    found = [g for g in got if (g[0], g[2]) in score]
    assert len(found) >= 0.9 * len(want)
    assert all(abs(score[g[0], g[2]] - g[3]) < 1e-12 for g in found)


def test_visits_widen_until_recall_is_reached(spark):
    """Half a tree's leaves give less than all of them, which give the brute-force rows."""
    df = read(spark, "/root/testdata/sf0.1", "embeddings")
    want = {(w[0], w[2]) for w in brute([(r.vec_id, r.embedding) for r in df.collect()])}
    recall = {share: len({(g[0], g[2]) for g in result(df, recall=share, sample=800, leaf=20)} & want) / len(want) for share in (0.5, 0.8, 1.0)}
    assert recall[0.5] < recall[0.8] < recall[1.0] == 1.0
    assert recall[0.5] > 0.4 and recall[0.8] > 0.7


def test_copies_ties_and_shards(spark):
    """A third of the rows is one vector; its multiples tie with it; many small shards and blocks."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, *[0.0] * 5, 1.0]) for i in range(200)] + [(2000 + i, [2.0, 4.0, *[0.0] * 5, 2.0]) for i in range(4)]
    df = spark.createDataFrame(rows, SHAPE)
    got = result(df, recall=1.0, leaf=10, shard=30, queries=3)
    want = brute(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-15)
    for g, w in zip(got, want):
        assert g[2] == w[2] or abs(g[3] - w[3]) < 1e-15
    assert [g[2] for g in got if g[0] == 1000] == [1001, 1002, 1003, 1004, 1005]


def test_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    odd = [(50, None), (150, None), (200, []), (250, [0.0] * 4), (300, [1.0, None, 1.0, 1.0]), (350, [float("nan")] * 4), (400, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (7, [9.9] * 4), (3, rows[3][1])]
    df = spark.createDataFrame(rows + odd, SHAPE)
    kept = [(i, min(v, [9.9] * 4) if i == 7 else v) for i, v in rows]
    want = brute(kept)
    got = result(df, recall=1.0)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[:3] for g in result(df.withColumn("vec", F.lit(1)).withColumn("leaf", F.lit(2)).withColumn("rank", F.lit(3)), recall=1.0)] == [w[:3] for w in want]


def test_each_length_by_itself_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (50, [0.0, 2.0, 0.0])]
    got = result(spark.createDataFrame(rows, SHAPE))
    assert [g[:3] for g in got] == [(0, 1, 1), (50, 1, 3), (50, 2, 2)]
    assert result(spark.createDataFrame(rows[:1], SHAPE)) == []
    assert result(spark.createDataFrame(rows[1:2], SHAPE)) == []
    assert result(spark.createDataFrame([], SHAPE)) == []


def test_single_precision_is_compared_in_double(spark):
    df = read(spark, "/root/testdata/sf0.001", "embeddings").where("vec_id < 60")
    got, want = result(df, recall=1.0), brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-14)
