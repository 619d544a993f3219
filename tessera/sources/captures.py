"""Captured answers of the registry as a data source of their own.

Captures lie as compressed JSON lines in buckets by code, ``<path>/of=<buckets>/bucket=<n>/part-*``. The source takes equality and IN on the code, so a lookup lists and reads the buckets of the
codes it asks for and nothing else; each file is a partition, read as a stream. What other filters ask, Spark evaluates behind the scan.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "lei_code string, captured_at string, status int, content_type string, body string"
COLUMNS = ("lei_code", "captured_at", "status", "content_type", "body")
#: Buckets of a new folder of captures, and rows of an Arrow batch.
BUCKETS, BATCH = 16, 1024


def bucket_of(code: str, buckets: int) -> int:
    return zlib.crc32(code.encode()) % buckets


def write_captures(answers: DataFrame, path: str, buckets: int = BUCKETS) -> str:
    """Write answers (the columns of SCHEMA) in buckets by code. Spark sizes the files, several for a bucket that holds much; rows without a code lie in a bucket that no lookup reads."""
    bucket = F.pmod(F.crc32(F.col("lei_code").cast("binary")), F.lit(buckets)).cast("int")
    line = F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"})
    rows = answers.select(line.alias("value"), bucket.alias("bucket")).hint("rebalance", "bucket")
    rows.write.partitionBy("bucket").option("compression", "gzip").text(f"{path}/of={buckets}")
    return path


@dataclass
class CaptureFile(InputPartition):
    """One file, none where nothing is to be read."""

    path: str | None


class CaptureReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.codes = uri, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and IN on the code are the source's; the others go back."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("lei_code",):
                asked = {x for x in (f.value if isinstance(f, In) else [f.value]) if x is not None}
                self.codes = asked if self.codes is None else self.codes & asked
            else:
                yield f

    def partitions(self) -> Sequence[CaptureFile]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        found = []
        for top in fs.get_file_info(pafs.FileSelector(root)):
            if not top.base_name.startswith("of="):
                continue
            buckets = int(top.base_name[3:])
            folders = [top.path] if self.codes is None else [f"{top.path}/bucket={b}" for b in sorted({bucket_of(c, buckets) for c in self.codes})]
            for folder in folders:
                inside = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=True))
                found += [CaptureFile(i.path) for i in inside if i.is_file and i.base_name.startswith("part-")]
        return found or [CaptureFile(None)]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            return
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        batch = lambda rows: pa.record_batch([pa.array([r.get(n) for r in rows], t) for n, t in zip(COLUMNS, types, strict=True)], list(COLUMNS))
        with fs.open_input_stream(partition.path) as stream:
            rows = []
            for line in io.BufferedReader(stream):
                row = json.loads(line)
                if self.codes is None or row.get("lei_code") in self.codes:
                    rows.append(row)
                if len(rows) == BATCH:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


class RegistryCaptures(DataSource):
    """``spark.read.format("registry_captures").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "registry_captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options["path"])


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures below a folder; filters on the code reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegistryCaptures)
    return spark.read.format("registry_captures").load(path)
