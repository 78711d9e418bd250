"""How an input is dealt to tasks, from the planner's estimate of its size; results never depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame

PART_BYTES, MOST_PARTS, SMALL_BYTES = 64 << 20, 20_000, 8 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """The planner's estimate, None where it has none (its default is a very large number)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def spread(df: DataFrame) -> DataFrame:
    """A small input over all cores: a file of one row group would keep one busy. Inputs above SMALL_BYTES stay as they are read."""
    size = estimated_bytes(df)
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size is not None and size <= SMALL_BYTES else df


def input_parts(df: DataFrame) -> int:
    """A number of shuffle partitions that follows the input."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-(estimated_bytes(df) or 0) // PART_BYTES)))
