"""Shared helpers: scratch tables in the cluster's checkpoint folder, ranks, ASCII text rules."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.sources.scratch import folder

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables written under spark.checkpoint.dir: they cut lineage and survive lost executors.

    Without that setting only a session in one process may use a folder of its machine.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = folder(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(_nullable(df.schema)).parquet(path)

    def close(self) -> None:
        """Deletes the whole folder, once no result is read from it any more."""
        self.drop("")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def let(value: Column, body) -> Column:
    """body(x) with value computed once: lambdas re-evaluate what they capture for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def strip_ascii(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def n_words(c: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a DataFrame by SQL functions alone: a literal that is parsed and unfolded."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def ranked(scratch: Scratch, df: DataFrame, order: list[Column], name: str, out: str = "rank") -> DataFrame:
    """Adds a gapless 0-based global rank without a single-task window.

    Rows are range-partitioned and sorted, written once (so positions are fixed), and each
    partition's first rank comes from the partition counts: one small row per partition.
    """
    part, pos = f"__{out}_part", f"__{out}_pos"
    ids = F.monotonically_increasing_id()
    sorted_ = df.orderBy(*order).withColumn(part, F.shiftright(ids, 33).cast("int")).withColumn(pos, ids.bitwiseAND(F.lit((1 << 33) - 1)))
    saved = scratch.save(sorted_, name)
    counts = sorted((r[0], r[1]) for r in saved.groupBy(part).count().collect())
    firsts = list(zip([p for p, _ in counts], itertools.accumulate((n for _, n in counts), initial=0), strict=False))
    side = local_rows(saved.sparkSession, firsts, "__p int, __first long")  # one row per partition
    joined = saved.join(F.broadcast(side), F.col(part) == F.col("__p"))
    return joined.withColumn(out, F.col("__first") + F.col(pos)).drop(part, pos, "__p", "__first")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows and 16 MB, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
