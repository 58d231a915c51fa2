"""Tables kept in hash buckets of a key: a run writes the buckets it touches and nothing else.

``rows/home=R/hash_bucket=B`` holds bucket B as run R wrote it; ``manifest/run=R`` tells, for every bucket, which run's folder holds it after R,
with its row count and the table's own statistics.  A manifest is written last, so a run that breaks off changes nothing for readers; a run
that is repeated reads the manifest before its own and writes the same rows again.  Only manifests, one small row per bucket, pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

HOME, BUCKET = "home", "hash_bucket"


def committed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers n of the folders ``path/<prefix>=n`` whose writer has finished, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = [n for n in names if n.startswith(f"{prefix}=")]
    done = [n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=", 1)[1]) for n in done)


@dataclass(frozen=True)
class BucketTable:
    """A table of ``schema`` in ``buckets`` buckets of ``key``; ``stats`` are aggregates kept for each bucket."""

    path: str
    key: str
    schema: StructType
    buckets: int = 1024
    stats: dict[str, Column] = field(default_factory=dict)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame, column: str) -> set[int]:
        """Buckets that hold any of the keys: as many numbers as there are buckets at most."""
        return {r[0] for r in keys.select(self.bucket(F.col(column))).distinct().collect()}

    def manifest(self, spark: SparkSession, before: int | None = None) -> dict[int, Row]:
        """What the newest run (earlier than ``before``) left: bucket to its row of the manifest."""
        runs = [r for r in committed(spark, f"{self.path}/manifest", "run") if before is None or r < before]
        return {r[BUCKET]: r for r in spark.read.parquet(f"{self.path}/manifest/run={runs[-1]}").collect()} if runs else {}

    def read(self, spark: SparkSession, buckets: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the given buckets, of all by default, as they were before run ``before``."""
        known = self.manifest(spark, before)
        wanted = known.keys() if buckets is None else known.keys() & set(buckets)
        paths = [f"{self.path}/rows/{HOME}={known[b][HOME]}/{BUCKET}={b}" for b in sorted(wanted)]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, run: int, buckets: Iterable[int] | None = None, stats: dict[str, Column] | None = None) -> None:
        """Let ``rows`` be all rows of the given buckets (by default: of the whole table) from run ``run`` on; ``stats`` may stand in for the table's."""
        spark, folder = rows.sparkSession, f"{self.path}/rows/{HOME}={run}"
        old = {} if buckets is None else {b: r for b, r in self.manifest(spark, run).items() if b not in set(buckets)}
        ready = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn(BUCKET, self.bucket(F.col(self.key)))
        # an uneven bucket may become several files; no task needs to hold one
        ready.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        with_bucket = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        counted = spark.read.schema(with_bucket).parquet(folder).groupBy(BUCKET).agg(
            F.count(F.lit(1)).alias("n_rows"), *[c.alias(n) for n, c in (self.stats if stats is None else stats).items()]
        ).withColumn(HOME, F.lit(run).cast("long"))
        fresh = counted.collect()
        names = counted.columns
        lines = [tuple(r[n] for n in names) for r in [*old.values(), *fresh]]
        spark.createDataFrame(lines, counted.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/run={run}")


def highest(manifest: dict[int, Row], stat: str):
    """Greatest value of a statistic over all buckets, None without any."""
    return max((r[stat] for r in manifest.values() if r[stat] is not None), default=None)


