"""A table of conversations in buckets, of which a save rewrites only those that changed.

Layout: v<version>/bucket=<b>/*.parquet, and manifest-<version>.json, which names the version that every bucket is of. A save writes
the changed buckets under a new version, then the manifest of that version, made beside its place and renamed into it. Readers
take the last manifest: a save that stops before the rename has changed nothing, and its files are written over by the next.
Buckets and manifests that no manifest but the last two needs are deleted then. All through Spark's own file systems.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnengine.schema import EngineError

_MANIFEST = re.compile(r"manifest-(\d{12})\.json")


class BucketStore:
    """One table under a path; key is the column whose hash names the bucket."""

    def __init__(self, spark: SparkSession, path: str, key: str = "conversazione", buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self) -> list[str]:
        here = self._path(self.root)
        return [f.getPath().getName() for f in self._fs.listStatus(here)] if self._fs.exists(here) else []

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self._names() if (m := _MANIFEST.fullmatch(n)))

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest-{version:012}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self._versions())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int) -> None:
        """A version's buckets; adaptive execution splits a large one over tasks and merges small ones."""
        dealt = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v{version}")

    def _swap(self, version: int, manifest: dict) -> None:
        made, place = self._path(f"{self.root}/_manifest-{version:012}.tmp"), self._path(f"{self.root}/manifest-{version:012}.json")
        out = self._fs.create(made, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not self._fs.rename(made, place):
            raise EngineError(f"{place} is there already: two runs save to one table")
        self._clean()

    def _clean(self) -> None:
        kept = self._versions()[-2:]
        used = set(kept) | {v for k in kept for v in self._manifest(k)["versions"].values()}
        for name in self._names():
            found = _MANIFEST.fullmatch(name) or re.fullmatch(r"v(\d+)", name)
            if found and int(found[1]) not in (kept if name.startswith("manifest") else used):
                self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _written(self, version: int) -> list[int]:
        return [int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(self._path(f"{self.root}/v{version}")) if f.getPath().getName().startswith("bucket=")]

    def create(self, rows: DataFrame) -> None:
        """rows as the whole table, whatever was there."""
        version = (self._versions() or [0])[-1] + 1
        self._write(rows, version)
        self._swap(version, {"buckets": self.buckets, "schema": rows.schema.json(), "versions": {str(b): version for b in self._written(version)}})

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some buckets of it."""
        from pyspark.sql.types import StructType

        if not (versions := self._versions()):
            raise EngineError(f"there is no table under {self.root}")
        manifest = self._manifest(versions[-1])
        self.buckets = manifest["buckets"]
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.root}/v{v}/bucket={b}" for b, v in manifest["versions"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def update(self, changes: DataFrame, on: list[str]) -> list[int]:
        """Rows that match changes on some columns (the key among them) take its others; the buckets rewritten."""
        table = self.read()
        touched = sorted(r[0] for r in changes.select(self._bucket().alias("b")).distinct().collect())  # as many as there are buckets at most
        values = [c for c in changes.columns if c not in on]
        new = changes.select(*on, F.struct(*values).alias("_new"))
        rows = self.read(touched).join(new, on, "left")
        rows = rows.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])
        last = self._versions()[-1]
        self._write(rows, last + 1)
        manifest = self._manifest(last)
        manifest["versions"] |= {str(b): last + 1 for b in touched}
        self._swap(last + 1, manifest)
        return touched

    def remove(self) -> None:
        self._fs.delete(self._path(self.root), True)
