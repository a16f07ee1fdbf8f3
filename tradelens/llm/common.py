"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizer vocabularies are described; a parameter of every operator that uses one.
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # one machine: any folder of its own is shared
        configured = f"file://{tempfile.mkdtemp(prefix='tradelens-')}"
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the rereading of a file, not of the job before it.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table_name(path: str) -> str:
    return path.rpartition("/")[2].replace("-", "_")


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """Like ``stored``, as a table bucketed by ``key``: what groups by it reads a bucket and shuffles nothing.

    There are as many buckets as shuffle partitions at least, so that Spark keeps to them, and at most
    as many as it allows.
    """
    spark = df.sparkSession
    buckets = min(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), 100_000)
    path = scratch(spark, label)
    name = _table_name(path)
    written = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
    written.option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Have the driver drop what nothing refers to any more: Spark then deletes the shuffle files of jobs that are done.

    Spark itself does so every half hour; jobs that shuffle much in a row fill the disks before that.
    """
    spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` or ``bucketed`` returned, once nothing reads them, and drop the latter from the catalog."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    shared = shared_dir(spark).partition(":")[2] or shared_dir(spark)
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if shared.lstrip("/") in folder:  # never what was given
                spark.sql(f"DROP TABLE IF EXISTS {_table_name(folder)}")
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder, for small tables."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def tokenizer_file(name: str) -> str:
    """The file of a public tokenizer, by its name or as a path given by the caller."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def native_words(text):
    """Column: the words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    cut = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    return F.filter(cut, lambda w: w != F.lit(""))
