"""Line dedup over levelled sorted runs of line hashes.

The index is a list of runs: tables of (h1, h2, owner) bucketed and sorted by the
128-bit hash of a line's key. A batch of documents aggregates its keys to the
smallest doc_id holding each, merge-anti-joins every run, and what no run holds
becomes a new run of level 0. FANOUT runs of a level are merged, bucket by bucket and
without a shuffle, into one of the next, so n batches leave O(log n) runs. Batches must
come in ascending doc_id order; then a key's owner, its smallest doc_id, is settled when it
first enters a run. An index in a folder of its own can be opened again to take further batches.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys
shorter than min_chars code points are never dropped. The owner keeps all its lines.

Defined cases: a null text is one empty line; rows with equal doc_id count as one
document; a null doc_id comes after all others and never owns a line that a numbered
document holds; documents that lose every line keep an empty text; an empty table
gives an empty result; further columns are untouched.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, let, lower_ascii, strip_ascii, text_or_empty
from docspark.sources.parts import input_parts

FANOUT = 2
LAST_ID = (1 << 63) - 1


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


RUN = "h1 bigint, h2 bigint, owner bigint"


class LineIndex:
    """Levelled runs kept as bucketed, sorted tables, so joining two runs needs no shuffle of either.

    The tables stand in the session's catalog only while the index is open; their files and the
    list of runs stay in root. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.name = spark, root.rstrip("/"), f"line_run_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.buckets, self.made = buckets, 0
        self._list = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_runs")
        self._fs = self._list.getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.exists(self._list):
            stream = self._fs.open(self._list)
            told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            self.levels, self.buckets, self.made = told["levels"], told["buckets"], told["made"]
            for run in self.runs():
                spark.sql(f"CREATE TABLE {self._table(run)} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{run}'")

    def __enter__(self) -> LineIndex:
        return self

    def __exit__(self, *_) -> None:
        """Takes the tables out of the catalog; the files stay."""
        for run in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")

    def _table(self, run: str) -> str:
        return f"{self.name}_{run}"

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        run = f"run_{self.made}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{run}").option("compression", "zstd").saveAsTable(self._table(run))
        return run

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def owners(self) -> DataFrame:
        """(h1, h2, owner) of every key seen so far; runs share no key.

        Read as plain files: a join with it shuffles both sides, so the lines of a very common key can be split.
        """
        runs = [f"{self.root}/{r}" for r in self.runs()]
        return self.spark.read.schema(RUN).parquet(*runs) if runs else self.spark.createDataFrame([], RUN)

    def add(self, keys: DataFrame) -> None:
        """keys: h1, h2, owner, one row per key of the batch."""
        fresh = keys
        for r in self.runs():
            fresh = fresh.join(self.spark.table(self._table(r)).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        old: list[str] = []
        self._push(self._write(fresh.repartition(self.buckets, "h1", "h2")), 0, old)
        stream = self._fs.create(self._list, True)
        stream.write(bytearray(json.dumps({"levels": self.levels, "buckets": self.buckets, "made": self.made}).encode()))
        stream.close()
        for r in old:  # only now does nothing name them
            self.spark.sql(f"DROP TABLE {self._table(r)}")
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{r}"), True)

    def _push(self, run: str, level: int, old: list[str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FANOUT:
            merge, self.levels[level] = self.levels[level], []
            merged = self.spark.table(self._table(merge[0]))
            for r in merge[1:]:
                # no key is on both sides: a merge of two sorted runs, each bucket in its own task
                other = self.spark.table(self._table(r)).withColumnRenamed("owner", "other").hint("merge")
                merged = merged.join(other, ["h1", "h2"], "full_outer").select("h1", "h2", F.coalesce("owner", "other").alias("owner"))
            old += merge
            self._push(self._write(merged), level + 1, old)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, th, pos, h1, h2 of every line whose key is long enough; (doc, th) names a row's text."""
    text = text_or_empty(text_col)
    lines = docs.select(F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(split_lines(text)).alias("pos", "line"))
    key = lower_ascii(strip_ascii(F.col("line")))
    return lines.select("doc", "th", "pos", key.alias("key")).where(F.char_length("key") >= min_chars).select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key", F.lit(2)).alias("h2"))


def dropped_lines(docs: DataFrame, batches: int = 4, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", index: str | None = None) -> DataFrame:
    """doc, th, drops: sorted 0-based positions of the lines that a smaller doc_id owns.

    index: a folder whose index is opened, or begun, and takes the docs' keys; without it the docs stand alone.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    lines = scratch.save(line_keys(docs, id_col, text_col, min_chars), "lines")
    cuts = docs.agg(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    with LineIndex(spark, index or f"{scratch.root}/index", input_parts(docs)) as runs:
        for low, high in zip(bounds, bounds[1:], strict=False):
            batch = lines
            if low is not None:
                batch = batch.where(F.col("doc") > low)
            if high is not None:
                batch = batch.where(F.col("doc") <= high)
            runs.add(batch.groupBy("h1", "h2").agg(F.min("doc").alias("owner")))
        owners = runs.owners()
    hits = lines.join(owners, ["h1", "h2"]).where("doc > owner")
    return hits.groupBy("doc", "th").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def _kept(lines: Column, drops: Column) -> Column:
    """The lines between the dropped positions, as slices: linear in the lines."""
    return let(lines, lambda x: let(drops, lambda d: _between(x, d)))


def _between(lines: Column, drops: Column) -> Column:
    ends = F.concat(drops, F.array(F.size(lines)))
    cut = F.transform(ends, lambda end, i: F.slice(lines, F.when(i == 0, F.lit(1)).otherwise(F.get(drops, i - 1) + 2), end - F.when(i == 0, F.lit(0)).otherwise(F.get(drops, i - 1) + 1)))
    return F.flatten(cut)


def dedup_lines(docs: DataFrame, batches: int = 4, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", index: str | None = None) -> DataFrame:
    """docs with text_col rewritten, plus n_lines and n_dropped. index: see dropped_lines; its documents have smaller ids than docs."""
    drops = dropped_lines(docs, batches, min_chars, id_col, text_col, index)
    text = text_or_empty(text_col)
    keyed = docs.withColumn("__doc", F.coalesce(F.col(id_col), F.lit(LAST_ID))).withColumn("__th", F.xxhash64(text))
    right = drops.select(F.col("doc").alias("__d"), F.col("th").alias("__t"), F.col("drops").alias("__drops")).hint("shuffle_hash")
    joined = keyed.join(right, (F.col("__doc") == F.col("__d")) & (F.col("__th") == F.col("__t")), "left")
    none = F.array().cast("array<int>")
    lines, drops_ = split_lines(text), F.coalesce(F.col("__drops"), none)
    out = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    kept = F.when(F.size(drops_) == 0, text).otherwise(F.array_join(_kept(lines, drops_), "\n"))
    return joined.select(*out, kept.alias(text_col), F.size(lines).cast("long").alias("n_lines"), F.size(drops_).cast("long").alias("n_dropped"))
