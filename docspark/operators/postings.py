"""Token counts of texts, in Arrow batches.

A document's tokens are counted where the document is, so only distinct terms leave a task and
nothing is shuffled to count them. Texts come lower-cased by Spark, as UTF-8: every byte of a
character that is not an ASCII letter or digit separates, so tokens are found on bytes.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDERS = 64
#: Postings and terms that a worker holds before it gives them away, and rows of a batch it gives.
RUN, HELD, SLICE = 1 << 20, 1 << 20, 1 << 16
ALNUM = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))

Batches = Iterator[pa.RecordBatch]


def folder(term: bytes) -> int:
    return zlib.crc32(term) % FOLDERS


def words(low: bytes, min_length: int) -> list[bytes]:
    found = low.translate(ALNUM).split()
    return found if min_length <= 1 else [w for w in found if len(w) >= min_length]


def _sliced(batch: pa.RecordBatch) -> Batches:
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


def _postings(min_length: int, dealt: bool) -> Callable[[Batches], Batches]:
    def run(ids: list[pa.Array], held: list[int], lens: list[int], codes: list[int], tfs: list[int], code: dict[bytes, int]) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(held), dtype=np.int32), held)
        length, tf, at = np.array(lens, np.int32), np.fromiter(tfs, np.int64, len(tfs)), np.fromiter(codes, np.int32, len(codes))
        distinct, names = pa.array(list(code), pa.binary()), ["id", "len", "term", "tf"]
        if dealt:
            names, f = [*names, "f"], np.fromiter(map(folder, code), np.int32, len(code))
            ranked = pc.sort_indices(pa.RecordBatch.from_arrays([pa.array(f), distinct], ["f", "term"]), [("f", "ascending"), ("term", "ascending")]).to_numpy()
            rank = np.empty(len(code), np.int32)
            rank[ranked] = np.arange(len(code), dtype=np.int32)
            order = np.argsort(rank[at], kind="stable")
            doc, at, tf = doc[order], at[order], tf[order]
        out = [pa.concat_arrays(ids).take(pa.array(doc)), pa.array(length[doc]), distinct.cast(pa.string()).take(pa.array(at)), pa.array(tf), *([pa.array(f[at])] if dealt else [])]
        return pa.RecordBatch.from_arrays(out, names)

    def count(batches: Batches) -> Batches:
        ids, held, lens, codes, tfs, code = [], [], [], [], [], defaultdict(itertools.count().__next__)
        for batch in batches:
            start = 0
            for i, low in enumerate(batch.column(1).to_pylist(), 1):
                found = words(low, min_length)
                counts = Counter(found)
                held.append(len(counts))
                lens.append(len(found))
                codes.extend(map(code.__getitem__, counts))
                tfs.extend(counts.values())
                if len(codes) >= RUN:
                    yield from _sliced(run([*ids, batch.column(0).slice(start, i - start)], held, lens, codes, tfs, code))
                    start, ids, held, lens, codes, tfs, code = i, [], [], [], [], [], defaultdict(itertools.count().__next__)
            ids.append(batch.column(0).slice(start))
        if codes:
            yield from _sliced(run(ids, held, lens, codes, tfs, code))

    return count


def _lengths(min_length: int) -> Callable[[Batches], Batches]:
    def count(batches: Batches) -> Batches:
        for batch in batches:
            lens = [len(words(low, min_length)) for low in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lens, pa.int32())], ["id", "len"])

    return count


def _frequencies(min_length: int) -> Callable[[Batches], Batches]:
    def give(held: Counter) -> Batches:
        return _sliced(pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "df"]))

    def count(batches: Batches) -> Batches:
        held: Counter = Counter()
        for batch in batches:
            for found in map(words, batch.column(0).to_pylist(), itertools.repeat(min_length)):
                held.update(set(found))
                if len(held) >= HELD:
                    yield from give(held)
                    held = Counter()
        yield from give(held)

    return count


def _bounded(docs: DataFrame) -> DataFrame:
    """Arrow batches of at most 2,000 rows and 16 MB, so that long texts don't fill a worker's memory."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return docs


def _low(docs: DataFrame) -> DataFrame:
    return _bounded(docs).select("id", F.lower("text").cast("binary").alias("low"))


def postings(docs: DataFrame, min_length: int, dealt: bool = False) -> DataFrame:
    """id, len, term, tf of every document's distinct terms, from id and text (not null).

    dealt adds the term's folder f; the rows then come in runs sorted by f and term.
    """
    kind = docs.schema["id"].dataType.simpleString()
    return _low(docs).mapInArrow(_postings(min_length, dealt), f"id {kind}, len int, term string, tf long" + ", f int" * dealt)


def lengths(docs: DataFrame, min_length: int) -> DataFrame:
    """id, len of every document."""
    return _low(docs).mapInArrow(_lengths(min_length), f"id {docs.schema['id'].dataType.simpleString()}, len int")


def frequencies(docs: DataFrame, min_length: int) -> DataFrame:
    """term, df: parts of the number of documents that hold a term, to be summed."""
    return _low(docs).select("low").mapInArrow(_frequencies(min_length), "term string, df long")
