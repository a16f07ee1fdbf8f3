"""Landed files: whole files with their metadata, set aside where they cannot be read, and the choice of a filing's document.

A filing is a folder named by its accession number, with one or more documents below it. Folders and
files may be written plainly (``<accession>/<document>``) or as partitions
(``accession_number=<accession>/document=<document>/part-...``). A name that ends in ``.gz`` is that of a
file in gzip, whose document has the name before it.
"""

from __future__ import annotations

import gzip
import io
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_MAP_SCHEMA = "cik string, accessionNumber array<string>, primaryDocument array<string>"
_PLACE = r"(?:^|/)(?:accession_number=)?([^/=]+)/(?:document=)?([^/=]+?)(?:/part-[^/]*|\.gz)?$"


def plain_accession(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def decoded(content: Column) -> Column:
    """Text of a file: as its XML declaration says if that is Latin-1, else UTF-8; null if the bytes are no UTF-8."""
    latin = F.decode(F.substring(content, 1, 200), "ISO-8859-1").rlike(r"""(?i)^\s*<\?xml[^>]*encoding\s*=\s*["'](iso-8859-1|latin-?1)["']""")
    text = F.when(latin, F.decode(content, "ISO-8859-1")).otherwise(F.try_validate_utf8(content.cast("string")))
    return F.when(text.startswith("\uFEFF"), F.substr(text, F.lit(2))).otherwise(text)


def unpacked(content: Column, most_bytes: int) -> Column:
    """The bytes of a file in gzip, at most one more than ``most_bytes``; null if it is damaged."""

    def unpack(packed):
        try:
            with gzip.open(io.BytesIO(packed)) as f:
                return f.read(most_bytes + 1)
        except (EOFError, OSError, zlib.error):
            return None

    return F.udf(lambda b: None if b is None else unpack(b), "binary")(content)


#: Tasks for each core that folders are listed by, and files are read by at least.
_TASKS = 4
#: Spark's parts of small files that a task reads at most, where there are enough tasks.
_PARTS = 16
#: Rows that a task holds at once while it writes files.
_AT_ONCE = 64
#: The folder of rows without a value, as Spark's writers name it.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _local(spark: SparkSession, path: str) -> str | None:
    """The path in the file system of the machine, or null if it lies in another."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return files.makeQualified(at).toUri().getPath() if files.getUri().getScheme() == "file" else None


def write_files(files: DataFrame, path: str) -> None:
    """Write each row of (text, accession_number, document) as a file in gzip, as a partition of its accession number and document.

    Rows of a task that follow each other with the same two share a file, each on a line of its own. In the
    file system of the machine tasks write the files themselves: Hadoop would start a process (chmod) for
    each folder, file and checksum. Elsewhere Spark's writer makes them. Where a task is tried again, it replaces its files.
    """
    spark, files = files.sparkSession, files.select("text", "accession_number", "document")
    root = _local(spark, path)
    if root is None:
        files.write.partitionBy("accession_number", "document").option("compression", "gzip").text(path)
        return

    def work(parts: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, met = TaskContext.get(), Counter()
        passing = f".{task.taskAttemptId()}"
        rows = (tuple(c[i].as_py() for c in part.columns) for part in parts for i in range(part.num_rows))
        for folder, same in groupby(rows, lambda r: f"{root}/accession_number={r[1] or _NO_VALUE}/document={r[2] or _NO_VALUE}"):
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{passing}", "wb") as raw, gzip.GzipFile(filename="", fileobj=raw, mode="wb", compresslevel=1) as f:
                for text, *_ in same:
                    f.write((text or b"") + b"\n")
            os.replace(f"{folder}/{passing}", f"{folder}/part-{task.partitionId():05d}-{met[folder]}.txt.gz")
            met[folder] += 1
        yield pa.RecordBatch.from_arrays([pa.array([met.total()], pa.int64())], ["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, _AT_ONCE)
    try:
        files.withColumn("text", F.col("text").cast("binary")).mapInArrow(work, "n long").agg(F.sum("n")).collect()
    finally:
        spark.conf.set(key, before)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path``; a task lists many folders, where Spark would start one for each of up to 10,000."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), _TASKS * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    finally:
        spark.conf.set(key, before)


def scan_files(spark: SparkSession, path: str, most_bytes: int = 16 << 20) -> DataFrame:
    """accession_number, document, modified, n_bytes, status and text of every file below ``path``.

    status: ok, empty (white space only; Spark leaves out files of no bytes), not_text or too_large. Small files are packed into tasks by their bytes
    (``spark.sql.files.maxPartitionBytes``, ``openCostInBytes``); of files over ``most_bytes`` only the
    metadata are read. ``n_bytes`` is that of the file as it lies there; a file in gzip is too large by what
    it holds as well, and is unpacked no further than that shows.
    """
    files = _listed(spark, path)
    parts = files.rdd.getNumPartitions()
    parts = min(parts, max(_TASKS * spark.sparkContext.defaultParallelism, parts // _PARTS))  # of small files a task reads several parts
    meta = [F.col("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("n_bytes")]
    packed = F.col("path").endswith(".gz")
    held = files.where(F.col("length") <= most_bytes).coalesce(parts).withColumn("_unpacked", unpacked(F.when(packed, F.col("content")), most_bytes))
    held = held.withColumn("_bytes", F.when(packed, F.col("_unpacked")).otherwise(F.col("content")))
    over = F.coalesce(F.length("_bytes") > most_bytes, F.lit(False))
    small = held.select(*meta, over.alias("_over"), F.when(~over, decoded(F.col("_bytes"))).alias("text"))
    large = files.where(F.col("length") > most_bytes).coalesce(parts).select(*meta, F.lit(True).alias("_over"), F.lit(None).cast("string").alias("text"))
    status = F.when(F.col("_over"), "too_large").when(F.col("text").isNull(), "not_text").when(~F.col("text").rlike(r"\S"), "empty").otherwise("ok")
    place = [F.regexp_extract("path", _PLACE, 1).alias("accession_number"), F.regexp_extract("path", _PLACE, 2).alias("document")]
    return small.unionByName(large).select(plain_accession(place[0]).alias("accession_number"), place[1], "modified", "n_bytes", status.alias("status"), "text")


def set_aside(files: DataFrame) -> DataFrame:
    """The files that cannot be read, without their text."""
    return files.where("status <> 'ok'").drop("text")


def read_document_map(spark: SparkSession, path: str) -> DataFrame:
    """accession_number and document from landed listings, one JSON object for each company."""
    from tradelens.sources.readers import primary_documents

    return primary_documents(spark.read.schema(DOCUMENT_MAP_SCHEMA).json(path)).where("document <> ''").dropDuplicates(["accession_number"])


def filing_documents(files: DataFrame, primary: DataFrame) -> DataFrame:
    """accession_number, document, via and xml: one row for each filing that has a file.

    ``via`` is ``primary`` if the listing's document is a filing in XML, else ``index`` if another file
    of the folder is (an ``.xml`` that starts with a tag; of several the first by name). A filing with
    neither keeps a row without document and xml.
    """
    head = F.substring("text", 1, 500)
    starts = F.ltrim(F.regexp_replace(head, r"^\s+", ""))
    # the map's short rows are what is hashed, so texts are not sorted for the join
    named = files.join(primary.select("accession_number", F.col("document").alias("_named")).hint("shuffle_hash"), "accession_number", "left")
    is_named = F.col("document").eqNullSafe(F.col("_named"))
    first = is_named & (starts.startswith("<?xml") | head.contains("<ownershipDocument"))
    second = ~is_named & F.lower("document").endswith(".xml") & starts.startswith("<")
    via = F.when(F.col("status") != "ok", None).when(first, "primary").when(second, "index")
    judged = named.select("accession_number", "document", via.alias("via"), F.when(via.isNotNull(), F.col("text")).alias("xml"))
    place = Window.partitionBy("accession_number").orderBy(F.when(F.col("via") == "primary", 1).when(F.col("via") == "index", 2).otherwise(3), "document")
    best = judged.withColumn("_place", F.row_number().over(place)).where("_place = 1")
    return best.select("accession_number", F.when(F.col("via").isNotNull(), F.col("document")).alias("document"), "via", "xml")
