"""Merges into stored tables: only the partitions that a merge touches are written anew.

A table is a folder of Parquet partitions and of versions. A version is a small JSON file: for each partition
value the folder that holds it (one entry a partition, not a file), and for each source of batches the last
batch that was applied. A merge reads and rewrites the partitions in which its keys lie, every other entry is
copied, and the new version appears by one rename that fails if another writer was first. A batch that is
applied again (a streaming micro-batch after a failure) is recognised by its number and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class MergedTable:
    """A stored table of one schema; ``by`` is the column (part of the rows) whose values are the partitions."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: str) -> None:
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, by
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # -- versions

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        folder = self._path("versions")
        fs = folder.getFileSystem(self._conf)
        if not fs.exists(folder):
            return 0
        return max((int(n[:-5]) for f in fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "partitions": {}, "batches": {}}
        file = self._path("versions", f"{version}.json")
        stream = file.getFileSystem(self._conf).open(file)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, state: dict) -> int:
        """Make ``state`` the version after the one it was read from, or fail."""
        version = state["version"] + 1
        waiting, final = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"{version}.json")
        fs = final.getFileSystem(self._conf)
        out = fs.create(waiting, False)
        out.write(bytearray(json.dumps(state | {"version": version}).encode()))
        out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(waiting, final, options)
        except Exception as e:
            fs.delete(waiting, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} is another writer's") from e
            raise
        return version

    def holds(self, batch: tuple[str, int] | None) -> bool:
        """Has this batch (source, number) been applied?"""
        return bool(batch) and self.state()["batches"].get(batch[0], -1) >= batch[1]

    # -- rows

    def read(self, version: int | None = None, only: set[str] | None = None) -> DataFrame:
        """The rows of a version, or of some of its partitions."""
        folders = [f for k, f in self.state(version)["partitions"].items() if only is None or k in only]
        return self._rows(folders)

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def rewrite(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """Replace the partitions listed in ``touched`` by ``change`` of their rows, as one version.

        ``touched``: partition values, one column; they are collected, so their number must be that of
        partitions. ``change`` may give rows of those partitions only. ``batch``: (source, number).
        """
        if self.holds(batch):
            return self.version()
        state = self.state()
        values = [r[0] for r in touched.distinct().collect()]
        keys = {"" if v is None else str(v): v for v in values}
        old = self._rows([f for k, f in state["partitions"].items() if k in keys])
        run = f"data/{uuid.uuid4().hex}"
        name = F.coalesce(F.col(self.by).cast("string"), F.lit(""))
        # a large partition is written by several tasks, small ones share one
        change(old).select(*self.schema.fieldNames()).withColumn("_p", F.concat(F.lit("v"), name)).hint("rebalance", "_p").write.partitionBy("_p").parquet(f"{self.path}/{run}")
        fs = self._path(run).getFileSystem(self._conf)
        filled = {n for f in fs.listStatus(self._path(run)) if (n := f.getPath().getName()).startswith("_p=")}
        folders = {k: f"_p={self._escaped(k)}" for k in keys}
        if not filled <= set(folders.values()):
            raise ValueError(f"rows of partitions that were not listed: {sorted(filled - set(folders.values()))[:5]}")
        state["partitions"] = {k: f for k, f in state["partitions"].items() if k not in keys} | {k: f"{run}/{f}" for k, f in folders.items() if f in filled}
        if batch:
            state["batches"][batch[0]] = batch[1]
        try:
            return self.commit(state)
        except Conflict:
            fs.delete(self._path(run), True)  # no version lists it
            raise

    def _escaped(self, value: str) -> str:
        return self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(f"v{value}")

    def merge(self, new: DataFrame, keys: list[str], overwrite: list[str], fill: list[str] = (), batch: tuple[str, int] | None = None) -> int:
        """Upsert by key, with the rules of ``tables.upsert``. The partition column must be one of the keys' or follow from them."""
        from tradelens.operators.tables import upsert

        return self.rewrite(new.select(self.by), lambda old: upsert(old, new, keys, overwrite, fill), batch)

    def insert(self, new: DataFrame, keys: list[str], batch: tuple[str, int] | None = None) -> int:
        """Add the rows whose key is not stored; stored rows stay as they are."""
        from tradelens.operators.tables import insert_new

        return self.rewrite(new.select(self.by), lambda old: insert_new(old, new, keys), batch)
