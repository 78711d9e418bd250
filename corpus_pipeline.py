"""The training-data pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage reads what its predecessor kept, as Parquet written under the cluster's checkpoint
folder. Defined cases are those of the operators; documents whose id occurs in several rows
keep or lose all of them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import minhash, mixing, quality, sharding, tiling
from docspark.llm.common import Scratch, read

#: Near-duplicate selection, fuzzy tiling and hash coins are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules keep. Null and empty texts fail the fixed rules; without labels only those act; further columns stay."""
    # the row travels whole, so columns that bear a figure's name stay as they are
    rows = docs.select("doc_id", "text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return quality.verdicts(rows, read(spark, sf_dir, "labels"), keep_text=False).where("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group at similarity 0.8. Rows without words stay; null ids come after all others."""
    return minhash.keep_one(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that cover no benchmark item by half. An empty benchmark leaves all."""
    return tiling.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's rate and its coin say, so a row may come twice or go. A null source is a source."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; copies of a text share a shard."""
    return sharding.shard(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written and its predecessor's table deleted."""
    scratch = Scratch(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
