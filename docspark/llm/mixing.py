"""Mixing sources to target weights.

Token counts are summed per source, targets follow by water-filling the weights
under a cap of repeats, and the repetition rate of a source is target / size. Each
document is emitted floor(rate) times plus one Bernoulli copy whose probability is
the fraction; the coin is a seeded hash of the row, so reruns agree. Per source the
seed comes from a fixed list: the one whose copies sum nearest to the target, all
tried in one aggregation, so short sources with a few long documents stay close.

Defined cases: null text has size 0 and is never taken; sources are ordered by code
point with null last, and null is a source; rows with equal doc_id and text toss the
same coin; an empty table gives an empty result; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, n_words, ranked, text_or_empty

SEEDS = 32
BROADCAST_SOURCES = 10_000


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeats: float) -> DataFrame:
    """source, source_size, target of every source: weighted shares capped at max_repeats x size.

    Each pass caps the sources above their limit and reshares what they leave by weight; a
    pass is two aggregates over one row per source.
    """
    by_source = ranked(scratch, sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "sources", "source_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    table = by_source.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    capped, n_capped = F.lit(False), -1
    while True:
        row = table.agg(
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)).alias("free"),
            F.sum(capped.cast("long")).alias("n"),
        ).first()
        if row["n"] is None or row["n"] == n_capped:
            break
        n_capped, level = row["n"], (total * share - row["fixed"]) / row["free"] if row["free"] else float("inf")
        capped = (F.col("weight") * F.lit(level)) >= F.col("cap")
        if level == float("inf"):
            break
    target = F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.lit(level)) if n_capped >= 0 else F.lit(0.0)
    return scratch.save(table.select("source", "source_size", target.cast("double").alias("target")), "targets")


def _coin(seed: Column | int) -> Column:
    """Uniform in [0, 1) from the row's identity and the seed."""
    h = F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed, F.col("h"))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def rates(docs: DataFrame, weights: tuple[float, ...], share: float, max_repeats: float, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, h, size, source of every row; and source, source_size, target, whole, part, seed of every source."""
    scratch = Scratch(docs.sparkSession, "mix")
    text = text_or_empty(text_col)
    rows = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("h"), n_words(text).alias("size"), F.col(source_col).cast("string").alias("source")), "sizes")
    goal = targets(scratch, rows, weights, share, max_repeats)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(rate + F.lit(1e-12))).withColumn("part", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    joined = _join_source(rows, goal)
    tries = [F.sum(F.when(_coin(s) < F.col("part"), F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(SEEDS)]
    sums = joined.groupBy("source").agg(*[F.first(c).alias(c) for c in ("target", "whole", "part", "source_size")], *tries)
    miss = [F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{s}") - F.col("target")).alias("miss"), F.lit(s).alias("seed")) for s in range(SEEDS)]
    return rows, scratch.save(sums.select("source", "source_size", "target", "whole", "part", F.least(*miss)["seed"].alias("seed")), "rates")


def _n_copies() -> Column:
    return (F.col("whole") + (_coin(F.col("seed")) < F.col("part")).cast("long")).cast("long")


def copies(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeats: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, n_copies of every row."""
    rows, goal = rates(docs, weights, share, max_repeats, id_col, text_col, source_col)
    return _join_source(rows, goal).select("doc_id", "size", "source", "source_size", "target", _n_copies().alias("n_copies"))


def _join_source(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """A broadcast where the counted sources are few, else a shuffled join whose hot sources AQE splits."""
    side = by_source.withColumnRenamed("source", "__source")
    if side.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, rows["source"].eqNullSafe(F.col("__source"))).drop("__source")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeats: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed table: every row of docs n_copies times, with docs' columns. The texts are not shuffled."""
    _, goal = rates(docs, weights, share, max_repeats, id_col, text_col, source_col)
    goal = goal.select(F.col("source").alias("__key"), "whole", "part", "seed")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = docs.select(row, F.xxhash64(F.col(id_col), text_or_empty(text_col)).alias("h"), F.col(source_col).cast("string").alias("source"))
    out = _join_source(keyed, goal.withColumnRenamed("__key", "source")).withColumn("n", _n_copies()).where("n > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("__row.*")
