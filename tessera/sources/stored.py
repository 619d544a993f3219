"""Tables that change: merges that rewrite only the touched parts, behind manifests that switch as a whole."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Manifest:
    """A version of a table: which folder holds each bucket, and the last change taken from each source of numbered changes."""

    version: int
    schema: str
    keys: list[str]
    buckets: int
    parts: dict[str, str] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)


class StoredTable:
    """A keyed table in a folder, dealt to a fixed number of buckets by the hash of its key.

    A change writes new folders for the buckets it touches and then a manifest that points to them and to the old folders of the others. A manifest is created, never overwritten: of two writers that start from the same version
    one fails and may try again, and what a failed change has written no manifest names. Readers keep the version they began with. Changes that carry a source and a number are taken once: one that comes again, as after a
    restart, does nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self.hadoop(f"{self.path}/manifest")
        if not self.files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self.files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no table in {self.path}")
        number = versions[-1] if version is None else version
        lines = self.spark.read.text(f"{self.path}/manifest/{number:08d}.json", wholetext=True).first()
        return Manifest(**json.loads(lines["value"]))

    def _commit(self, manifest: Manifest) -> None:
        """Written aside and renamed, which fails where the version exists, so a manifest is whole or absent."""
        aside, final = (self.hadoop(f"{self.path}/manifest/{name}") for name in (f".{manifest.version:08d}-{id(manifest)}", f"{manifest.version:08d}.json"))
        out = self.files.create(aside, True)
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        if self.files.exists(final) or not self.files.rename(aside, final):
            self.files.delete(aside, False)
            raise RuntimeError(f"version {manifest.version} of {self.path} was written by another change")

    def _dealt(self, df: DataFrame, manifest: Manifest) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*manifest.keys), F.lit(manifest.buckets).cast("long")).cast("int"))

    def _write(self, df: DataFrame, manifest: Manifest, touched: list[int], source: str | None, number: int | None) -> None:
        after = Manifest(manifest.version + 1, manifest.schema, manifest.keys, manifest.buckets, dict(manifest.parts), dict(manifest.taken))
        folder = f"data/{after.version:08d}-{id(after)}"
        self._dealt(df, manifest).repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        for bucket in touched:
            after.parts.pop(str(bucket), None)
        written = {s.getPath().getName().removeprefix("bucket=") for s in self.files.listStatus(self.hadoop(f"{self.path}/{folder}")) if s.isDirectory()}
        after.parts |= {bucket: f"{folder}/bucket={bucket}" for bucket in written}
        if source is not None:
            after.taken[source] = number
        self._commit(after)

    def create(self, df: DataFrame, keys: list[str], buckets: int = 16) -> StoredTable:
        """The first version; the rows must have distinct keys."""
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).json()
        self._write(df, Manifest(-1, schema, keys, buckets), list(range(buckets)), None, None)
        return self

    def read(self, version: int | None = None) -> DataFrame:
        return self._parts(self.manifest(version))

    def _parts(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        chosen = [f"{self.path}/{folder}" for bucket, folder in sorted(manifest.parts.items()) if buckets is None or int(bucket) in buckets]
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        return self.spark.read.schema(schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], schema)

    def _touched(self, rows: DataFrame, manifest: Manifest) -> list[int]:
        return sorted(r["bucket"] for r in self._dealt(rows, manifest).select("bucket").distinct().collect())  # at most a row a bucket

    def merge(self, changes: DataFrame, values: dict[str, Column] | None = None, delete: Column | None = None, insert: bool = True, source: str | None = None, number: int | None = None) -> bool:
        """Takes changes, of distinct keys, into the table: rows of a known key get ``values`` (expressions over ``old`` and ``new``, two structs; all columns of the new row if not given), or go where ``delete`` holds; rows of
        an unknown key are added if ``insert``, with ``values`` over an ``old`` that is null. False if the numbered change was taken before."""
        manifest = self.manifest()
        if source is not None and manifest.taken.get(source, -1) >= number:
            return False
        touched = self._touched(changes, manifest)
        columns = [f.name for f in T.StructType.fromJson(json.loads(manifest.schema))]
        old = self._parts(manifest, touched)
        pair = lambda df, name: df.select(*[F.col(k).alias(f"{name}_{i}") for i, k in enumerate(manifest.keys)], F.struct(*df.columns).alias(name))
        same = [F.col(f"old_{i}").eqNullSafe(F.col(f"new_{i}")) for i in range(len(manifest.keys))]
        both = pair(old, "old").join(pair(changes, "new"), same, "full_outer")
        if not insert:
            both = both.filter("old IS NOT NULL")
        if delete is not None:
            both = both.filter(~F.coalesce(F.col("new").isNotNull() & delete, F.lit(False)))
        values = values or {c: F.col(f"new.{c}") for c in changes.columns}
        keep = lambda c: F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")) if c in manifest.keys else F.col(f"old.{c}")
        rows = both.select(*[F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(values[c] if c in values else keep(c)).alias(c) for c in columns])
        self._write(rows, manifest, touched, source, number)
        return True

    def update(self, where: Column, values: dict[str, Column], source: str | None = None, number: int | None = None) -> bool:
        """Sets columns of the rows that meet a condition; only buckets with such rows are written again."""
        manifest = self.manifest()
        if source is not None and manifest.taken.get(source, -1) >= number:
            return False
        touched = self._touched(self._parts(manifest).filter(where), manifest)
        rows = self._parts(manifest, touched)
        hit = F.coalesce(where, F.lit(False))
        self._write(rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns]), manifest, touched, source, number)
        return True


def exists(spark: SparkSession, path: str) -> bool:
    try:
        StoredTable(spark, path).manifest()
    except (FileNotFoundError, AnalysisException):
        return False
    return True
