"""Where points are kept: Parquet partitioned by shard, under a folder that all
executors share; small state is JSON beside it, written as a new version."""

from __future__ import annotations

import json
import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

from ..plans.literals import SPARK_TYPES, UNITS

_DAY = UNITS["d"]


def shard_length(retention_ns: int) -> int:
    """Default shard length for a retention (0: unlimited)."""
    # Retention limits and the shard length up to each.
    for limit, length in ((2 * _DAY, UNITS["h"]), (7 * _DAY, _DAY), (90 * _DAY, 7 * _DAY)):
        if retention_ns and (retention_ns < limit or limit > 2 * _DAY and retention_ns == limit):
            return length
    return 30 * _DAY if retention_ns else 7 * _DAY


class Folder:
    """A folder on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *(quote(p, safe="") for p in parts)])

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """Complete versions of a document, the newest last."""
        found = [(x, re.fullmatch(re.escape(name) + r"\.(\d+)", x)) for x in self.children(self.root)]
        return sorted((int(m[1]), x) for x, m in found if m)

    def read_json(self, name: str) -> dict | None:
        versions = self._versions(name)
        if not versions:
            return None
        path = self._path(f"{self.root}/{versions[-1][1]}")
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(self._io.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write_json(self, name: str, value: dict) -> None:
        """Adds a version: it counts once it has its name, and only then older ones go,
        so a crash at any point leaves one that can be read."""
        versions = self._versions(name)
        new = self._path(f"{self.root}/{name}.new")
        stream = self._fs.create(new, True)
        stream.write(json.dumps(value, sort_keys=True).encode())
        stream.close()
        if not self._fs.rename(new, self._path(f"{self.root}/{name}.{versions[-1][0] + 1 if versions else 1}")):
            raise OSError(f"{name} can't be written")
        for _, old in versions:
            self._fs.delete(self._path(f"{self.root}/{old}"), False)

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def children(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self.exists(path) else []


def schema(tags: list[str], fields: dict[str, str]) -> StructType:
    kinds = {"time_ns": "bigint"} | dict.fromkeys(tags, "string") | {f: SPARK_TYPES[k] for f, k in fields.items() if f not in tags} | dict.fromkeys(("_batch", "_line", "_shard"), "bigint")
    out = StructType()
    for name, kind in kinds.items():
        out = out.add(name, {"bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "string": StringType()}[kind])
    return out


def shard_of(shard_ns: int) -> Column:
    """The start of the shard that ``time_ns`` is in."""
    return F.expr(f"time_ns div {shard_ns} * {shard_ns} - case when time_ns < 0 and time_ns % {shard_ns} <> 0 then {shard_ns} else 0 end")


def append(df: DataFrame, path: str, shard_ns: int) -> None:
    """Adds points; rows of one shard are brought together so that each batch adds
    few files to it. Large shards are split by size (rebalanced), small ones are not."""
    df.withColumn("_shard", shard_of(shard_ns)).hint("rebalance", "_shard").write.mode("append").partitionBy("_shard").parquet(path)


def merged(df: DataFrame, tags: list[str], fields: list[str]) -> DataFrame:
    """One point for each series and time; each field has the value written last."""
    last = F.struct("_batch", "_line")
    col = lambda n: F.col("`" + n.replace("`", "``") + "`")
    made = [F.max_by(col(f), F.when(col(f).isNotNull(), last)).alias(f) for f in fields]
    return df.groupBy("time_ns", *(col(t) for t in tags)).agg(*made) if made else df.select("time_ns", *(col(t) for t in tags)).distinct()
