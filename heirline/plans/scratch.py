"""Tables written between the rounds of an iterative job.

Every round ends in a Parquet table below the folder the cluster names in
``spark.checkpoint.dir``. That cuts the lineage, survives lost executors, gives the
planner true sizes for its join choice, and lets the next round read only the
columns it needs. Row counts come out of the writing job itself.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="heirline-"))
    return context.getCheckpointDir()


@dataclass(frozen=True)
class Stored:
    """A written table with the figures its writing job observed."""

    df: DataFrame
    path: str
    figures: dict

    @property
    def rows(self) -> int:
        return self.figures["rows"]


class Scratch:
    """One folder of intermediate tables, dropped as a whole by :meth:`release`."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.path = f"{(root or shared_folder(spark)).rstrip('/')}/heirline-{uuid.uuid4().hex}"
        self._numbers = itertools.count()
        self._tables: list[str] = []

    def place(self, name: str) -> str:
        """A fresh path below the folder."""
        return f"{self.path}/{next(self._numbers):04d}-{name}"

    def save(
        self,
        df: DataFrame,
        path: str,
        *,
        partition_by: tuple[str, ...] = (),
        figures: dict[str, Column] | None = None,
    ) -> Stored:
        """Write ``df`` and read it back; ``figures`` are observed on the way."""
        seen = Observation()
        wanted = {"rows": F.count(F.lit(1)), **(figures or {})}
        columns = [c.alias(n) for n, c in wanted.items()]
        writer = df.observe(seen, *columns).write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return Stored(self.read(path, df.schema), path, seen.get)

    def read(self, path: str, schema: T.StructType, *parts: str) -> DataFrame:
        """Read a written table, or the named parts of it, with its known schema."""
        reader = self.spark.read.schema(schema)
        if not parts:
            return reader.parquet(path)
        return reader.option("basePath", path).parquet(*[f"{path}/{p}" for p in parts])

    def save_bucketed(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
        """Write a table bucketed and sorted by ``keys``.

        Joins on the keys then need no shuffle of this side, and a bloom filter on
        the first key lets a look-up of a few ids skip most row groups.
        """
        table = f"heirline_{name}_{uuid.uuid4().hex}"
        (
            df.repartition(buckets, *keys)
            .write.format("parquet")
            .bucketBy(buckets, keys[0], *keys[1:])
            .sortBy(keys[0], *keys[1:])
            .option("path", self.place(name))
            .option(f"parquet.bloom.filter.enabled#{keys[0]}", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .saveAsTable(table)
        )
        self._tables.append(table)
        return self.spark.table(table)

    def discard(self, *tables: Stored) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            self._delete(table.path)

    def release(self) -> None:
        """Drop the bucketed tables and delete the folder."""
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
