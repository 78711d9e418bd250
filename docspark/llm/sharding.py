"""Sharding by minimax contiguous partition.

Equal texts are one atomic group; groups are ordered by a hash of their text. Groups above
an even share come first and fill a shard each. Over the rest the smallest feasible
capacity is found by binary search with a greedy check, and the cuts are made under it, as
near to even shares as it allows.

The driver never holds all groups. It begins with 2 ** CELL_BITS runs of groups (cells of the
hash) and splits those in which a cut of a best partition may fall, until they are single
groups or the capacity is known to be least. Each round is one aggregation of the rows in
the cells that are split; the number of runs stays below MOST_RUNS.

Defined cases: a null text has no bytes and belongs with the empty text; a null
doc_id is kept and sorts first; equal rows get slots of their own; an empty table
gives an empty result; further columns are ignored. A table whose groups are fewer
than the shards leaves the last shards empty. Texts with equal 64-bit hashes count as equal.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, ranked, text_or_empty

CELL_BITS, MOST_RUNS = 16, 1 << 17


def greedy_cuts(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """First cell of each shard but the first when none may exceed capacity; None if that needs more shards."""
    prefix = [0, *accumulate(sizes)]
    cuts, at = [], 0
    while at < len(sizes):
        end = bisect_right(prefix, prefix[at] + capacity) - 1
        if end == at or len(cuts) == shards:
            return None
        cuts.append(end)
        at = end
    return cuts[:-1]


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest capacity for which ordered sizes fit in the shards, and the cuts."""
    if not sizes:
        return 0, []
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, even_cuts(sizes, low, shards)


def even_cuts(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts under a feasible capacity, each the allowed one nearest to an even share, so that the last shards are not left short.

    A cut is allowed if its shard fits the capacity and the rest still fits the shards after it.
    """
    prefix = [0, *accumulate(sizes)]
    earliest = [len(sizes)]
    for _ in range(shards - 1):
        earliest.append(bisect_left(prefix, prefix[earliest[-1]] - capacity))
    earliest.reverse()
    cuts, at = [], 0
    for k in range(shards - 1):
        want = bisect_left(prefix, prefix[-1] * (k + 1) / shards)
        if want and prefix[want] + prefix[want - 1] > 2 * prefix[-1] * (k + 1) / shards:
            want -= 1
        latest = bisect_right(prefix, prefix[at] + capacity) - 1
        at = min(max(want, earliest[k], at), latest)
        cuts.append(at)
    return [c for c in cuts if c < len(sizes)]


@dataclass(frozen=True)
class Run:
    """Groups whose hashes agree above shift, in order: their least and largest hash and the sum of their sizes."""

    cell: int
    shift: int
    first: int
    last: int
    size: int

    @property
    def single(self) -> bool:
        return self.first == self.last


def doubtful(runs: list[Run], capacity: int, shards: int) -> list[Run]:
    """Runs of several groups in which a partition as good as capacity or better may cut."""
    prefix = [0, *accumulate(r.size for r in runs)]
    out = []
    for k in range(1, shards):
        low, high = prefix[-1] - (shards - k) * capacity, k * capacity
        i = max(bisect_right(prefix, low) - 1, out[-1] + 1 if out else 0)
        while i < len(runs) and prefix[i] < high:
            out.append(i)
            i += 1
    return [runs[i] for i in out if not runs[i].single]


def _cells(rows: DataFrame, shift: int) -> list[Run]:
    found = rows.groupBy(F.shiftright("h", shift).alias("c")).agg(F.min("h"), F.max("h"), F.sum("size")).collect()
    return [Run(c, shift, low, high, size) for c, low, high, size in found]


def plan(rows: DataFrame, shards: int) -> tuple[dict[int, int], list[int], int]:
    """Shard of each group that stands alone (by hash), the first hashes of the later shards, and the first shard they use."""
    runs = sorted(_cells(rows, 64 - CELL_BITS), key=lambda r: r.first)  # at most 2 ** CELL_BITS
    total = rest = sum(r.size for r in runs)
    full = [r.cell for r in runs if r.size * shards > total]
    heavy: list[tuple[int, int]] = []
    if full:  # at most shards cells, and as many groups
        groups = rows.where(F.shiftright("h", 64 - CELL_BITS).isin(full)).groupBy("h").agg(F.sum("size").alias("n"))
        heavy = [(n, h) for h, n in groups.where(F.col("n") * shards > total).collect()]
    alone: dict[int, int] = {}
    for n, h in sorted(heavy, key=lambda x: (-x[0], x[1])):
        left = shards - len(alone)
        if left <= 1 or n * left <= rest or n == rest:
            break
        alone[h] = len(alone)
        rest -= n
    rows = rows.where(~F.col("h").isin(list(alone))) if alone else rows
    if alone:
        touched = sorted({h >> (64 - CELL_BITS) for h in alone})
        runs = [r for r in runs if r.cell not in touched] + _cells(rows.where(F.shiftright("h", 64 - CELL_BITS).isin(touched)), 64 - CELL_BITS)
    left = shards - len(alone)
    while True:
        runs.sort(key=lambda r: r.first)
        capacity, cuts = minimax([r.size for r in runs], left)
        least = max([-(-rest // left), *(r.size for r in runs if r.single)])
        split = doubtful(runs, capacity, left) if capacity > least else []
        bits = min(8, (MOST_RUNS - len(runs)).bit_length() - len(split).bit_length() - 1) if split else 0
        if bits < 1:
            return alone, [runs[i].first for i in cuts], len(alone)
        chosen = set(split)
        runs = [r for r in runs if r not in chosen]
        for shift in sorted({r.shift for r in split}):
            inside = rows.where(F.shiftright("h", shift).isin([r.cell for r in split if r.shift == shift]))
            runs += _cells(inside, max(0, shift - bits))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    scratch = Scratch(docs.sparkSession, "shard")
    text = text_or_empty(text_col)
    rows = scratch.save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "sizes",
    )
    alone, firsts, base = plan(rows.select("h", "size"), shards)
    order = [F.col("shard"), F.col("h"), F.col("doc_id"), F.col("text_crc32")]
    placed = ranked(scratch, rows.withColumn("shard", _shard_of(alone, firsts, base)), order, "placed")
    starts: list[Column] = []
    for r in placed.groupBy("shard").agg(F.min("rank")).collect():  # one row per shard
        starts += [F.lit(r[0]), F.lit(r[1])]
    scratch.drop("sizes")
    slot = F.col("rank") - F.element_at(F.create_map(*starts), F.col("shard")) if starts else F.col("rank")
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


def _shard_of(alone: dict[int, int], firsts: list[int], base: int) -> Column:
    out = F.lit(base)
    for first in firsts:
        out = out + (F.col("h") >= F.lit(first)).cast("int")
    for own, k in alone.items():
        out = F.when(F.col("h") == F.lit(own), F.lit(k)).otherwise(out)
    return out.cast("int")
