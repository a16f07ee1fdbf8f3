"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet files that never change. Compaction takes the tiers of
similarly sized files that have ``fanout`` members or more and rewrites each tier into files of about
``target_bytes``. Each change is committed by one rename of a new manifest, which lists the files and
the columns of that version; readers see a version whole or not at all, and a failed job leaves only
files that no manifest lists. The rename fails where the version is there already. A file system whose
rename is not atomic (an object store) needs a lock around the writers.

Nulls, very long texts, repeated rows and further columns are kept as they are, whatever the columns
are called; columns that only some arrivals have are null in the others, and a column keeps the type
of its first arrival (another type is an error). An empty arrival adds columns, but no rows; an empty
store is an empty table. The order of rows is not kept.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


class ShardStore:
    """A table of shards below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, smallest: int = 64 << 10):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.smallest = target_bytes, fanout, smallest
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # -- manifest

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, columns, shards: [{path, bytes, tier}]}; the latest one if no version is given."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "columns": StructType([]).jsonValue(), "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, now: dict, columns: dict, shards: list[dict]) -> int:
        """Publish the version after ``now``. Fails if another writer has published it."""
        version = now["version"] + 1
        final, draft = (self._path(f"{self.root}/manifests/{name}") for name in (f"v{version}.json", f".{uuid.uuid4().hex}"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "columns": columns, "shards": shards}).encode()))
        out.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        try:  # without an option to overwrite, the rename is the test
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            self._fs.delete(draft, False)
            if not self._fs.exists(final):
                raise
            raise RuntimeError(f"version {version} was committed by another writer") from error
        return version

    @staticmethod
    def _with_columns_of(columns: dict, df: DataFrame) -> dict:
        """The columns of a manifest and those that ``df`` adds, all nullable."""
        known = StructType.fromJson(columns)
        for f in df.schema.fields:
            if f.name not in known.names:
                known = StructType([*known.fields, StructField(f.name, f.dataType, True)])
            elif known[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is {known[f.name].dataType.simpleString()} in the store, {f.dataType.simpleString()} in the arrival")
        return known.jsonValue()

    def tier(self, size: int) -> int:
        """Sizes within a factor of ``fanout`` share a tier."""
        return int(math.log(max(size, self.smallest) / self.smallest, self.fanout))

    def _written(self, df: DataFrame, by: str | None = None) -> list[dict]:
        """Write ``df`` below a new folder; the files that make it up."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        found, files = [], self._fs.listFiles(self._path(folder), True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                found.append({"path": f.getPath().toString(), "bytes": f.getLen(), "tier": self.tier(f.getLen())})
        return sorted(found, key=lambda s: s["path"])

    # -- operations

    def append(self, df: DataFrame) -> int:
        """Add one arrival."""
        now = self.manifest()
        columns = self._with_columns_of(now["columns"], df)
        return self._commit(now, columns, now["shards"] + self._written(df))

    def append_by(self, df: DataFrame, arrival) -> int:
        """Add many arrivals in one job and one commit: the rows of each value of ``arrival`` get shards of their own.

        Folders are named after a hash of the value, which may be long or null.
        """
        now = self.manifest()
        columns = self._with_columns_of(now["columns"], df)
        name = "_arrival"
        while name.lower() in (c.lower() for c in df.columns):
            name += "_"
        return self._commit(now, columns, now["shards"] + self._written(df.withColumn(name, F.hex(F.xxhash64(arrival))), name))

    def compact(self) -> int:
        """Merge tiers until none has ``fanout`` shards below the target size that can be joined. The version that results."""
        done: set[str] = set()  # files that merging gave back as many as it took
        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in now["shards"]:
                if s["bytes"] < self.target_bytes // 2 and s["path"] not in done:
                    tiers.setdefault(s["tier"], []).append(s)
            ready = [t for t in sorted(tiers) if len(tiers[t]) >= self.fanout]
            if not ready:
                return now["version"]
            run = tiers[ready[0]]
            files = max(1, round(sum(s["bytes"] for s in run) / self.target_bytes))
            merged = self._written(self._read(run, now["columns"]).coalesce(files))
            gone = {s["path"] for s in run}
            self._commit(now, now["columns"], [s for s in now["shards"] if s["path"] not in gone] + merged)
            if len(merged) >= len(run):
                done |= {s["path"] for s in merged}

    def _read(self, shards: list[dict], columns: dict) -> DataFrame:
        schema = StructType.fromJson(columns)
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        return self._read(found["shards"], found["columns"])

    def vacuum(self, keep: int = 1) -> int:
        """Delete files that none of the last ``keep`` manifests lists; the number of files deleted."""
        last = self.versions()[-keep:]
        listed = {s["path"] for v in last for s in self.manifest(v)["shards"]}
        files, gone = self._fs.listFiles(self._path(f"{self.root}/data"), True), []
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().endswith(".parquet") and path.toString() not in listed:
                gone.append(path)
        for path in gone:
            self._fs.delete(path, False)
        return len(gone)
