"""Merges rewrite the partitions they touch, once, and a writer that comes second fails."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.operators.merged import Conflict, MergedTable

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("month", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("alerted", T.BooleanType())])


@pytest.fixture
def table(spark, tmp_path):
    return MergedTable(spark, f"file://{tmp_path}/t", SCHEMA, "month")


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()))


def upsert(table, new, **kw):
    return table.merge(new, ["k", "month"], ["score"], **kw)


def test_untouched_partitions_keep_their_files(spark, table):
    assert table.version() == 0 and rows(table.read()) == []
    upsert(table, frame(spark, (1, "a", 1, True), (2, "b", 2, False), (3, "c / d=e", 3, None)))
    before = {p: set(table.read(only={p}).inputFiles()) for p in ("a", "b", "c / d=e")}
    upsert(table, frame(spark, (2, "b", 20, True), (4, "b", 4, True)))
    after = {p: set(table.read(only={p}).inputFiles()) for p in before}
    assert after["a"] == before["a"] and after["c / d=e"] == before["c / d=e"] and after["b"].isdisjoint(before["b"])
    assert rows(table.read()) == [(1, "a", 1, True), (2, "b", 20, False), (3, "c / d=e", 3, None), (4, "b", 4, True)]
    assert rows(table.read(1)) == [(1, "a", 1, True), (2, "b", 2, False), (3, "c / d=e", 3, None)]  # an older version stays readable


def test_inserts_leave_what_is_stored(spark, table):
    table.insert(frame(spark, (1, "a", 1, True)), ["k", "month"])
    table.insert(frame(spark, (1, "a", 9, False), (2, "a", 2, True), (2, "a", 2, True)), ["k", "month"])
    assert rows(table.read()) == [(1, "a", 1, True), (2, "a", 2, True)]


def test_the_second_of_two_writers_fails(spark, table):
    upsert(table, frame(spark, (1, "a", 1, True)))
    seen = table.state()
    upsert(table, frame(spark, (1, "a", 2, True)))
    with pytest.raises(Conflict):
        table.commit(seen)
    late = MergedTable(spark, table.path, SCHEMA, "month")
    late.state = lambda version=None: seen  # read before the other's commit
    with pytest.raises(Conflict):
        upsert(late, frame(spark, (1, "a", 3, True)))
    assert rows(table.read()) == [(1, "a", 2, True)] and table.version() == 2


def test_a_batch_counts_once(spark, table):
    first = frame(spark, (1, "a", 1, True))
    assert upsert(table, first, batch=("s", 0)) == 1
    add = lambda old: old.withColumn("score", F.col("score") + 1)
    assert table.rewrite(first.select("month"), add, ("s", 1)) == 2
    assert table.rewrite(first.select("month"), add, ("s", 1)) == 2
    assert table.rewrite(first.select("month"), add, ("other", 1)) == 3
    assert rows(table.read()) == [(1, "a", 3, True)]


def test_emptied_partitions_nulls_and_strays(spark, table):
    upsert(table, frame(spark, (1, "a", 1, True), (2, None, 2, True), (3, "b", 3, True)))
    assert rows(table.read(only={""})) == [(2, None, 2, True)]
    table.rewrite(frame(spark, (0, "a", 0, True), (0, None, 0, True)).select("month"), lambda old: old.where("false"))
    assert rows(table.read()) == [(3, "b", 3, True)]
    with pytest.raises(ValueError):
        table.rewrite(frame(spark, (0, "b", 0, True)).select("month"), lambda old: old.withColumn("month", F.lit("z")))
    assert rows(table.read()) == [(3, "b", 3, True)]
    assert upsert(table, frame(spark)) == table.version()


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    rows = MergedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], "k long, word string, month string").schema, "month")
    new = spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("word"), F.lit("m").alias("month"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "200k")
    try:
        rows.insert(new, ["k"])
    finally:
        spark.conf.set(size, before)
    assert len(list(tmp_path.glob("t/data/*/_p=vm/*.parquet"))) > 1 and rows.read().count() == 40_000
