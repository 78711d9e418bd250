"""Benchmark decontamination by greedy string tiling.

Windows of MIN_MATCH words of the benchmark items are the seeds; a running Karp-Rabin
hash over each document's words is looked up among them. For every (document, item)
that share a seed the tiling is exact: of all common runs the longest is marked, runs
that lost words to it are cut to what is left, and so on until no run of MIN_MATCH words
remains. An item's coverage is the marked share of its words, wherever in the document
the tiles stand, so reordered passages count in full. Documents covering an item to the
threshold are contaminated.

Words are runs of digits, a-z (after lower-casing) and non-ASCII characters.

Windows are equal if their 64-bit hashes are. A repetitive text may share very many windows
with a repetitive item; then the longest run is sought by bisecting its length over rolling
hashes, which needs no list of all pairs and marks the same words.

The items are read in blocks of about BLOCK_BYTES of text and a block's seeds are sent to all
tasks, a bounded broadcast. Documents are never shuffled: with several blocks each pass writes
the rows with what they gathered so far and the next one reads them, so the driver and the
tasks hold one block at a time, and each row gives one row.

Defined cases: null or empty texts, documents or items, share nothing; an item of fewer
than MIN_MATCH words is one seed and its own least tile, so it is covered where it stands
whole, and a one-word item covers every document with that word; an item with a null id is
searched like others and listed as null, after all ids; equal items count one by one; of equally covered items the
least id is best_item; null or repeated document ids stay rows of their own; an empty benchmark
leaves everything clean; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, bounded_batches
from docspark.llm.textnum import PLAIN, STEP, chunks, joined, shingle_hashes, word_hashes

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
FILTER_BITS = 22
#: Windows times items looked at together, and shared windows of a document and an item above which runs are bisected.
EXPAND, MANY_PAIRS = 1 << 20, 1 << 16
SCHEMA = "doc_id long, items array<long>, coverage double, best_item long"


def plain_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode().lower().translate(PLAIN), np.uint8)
    return word_hashes(data, data != 32)[0]


class Seeds:
    """Sorted distinct seed hashes behind a bit filter; of each the items that hold it, and their positions."""

    def __init__(self, items: list[tuple[int | None, str]], k: int):
        self.k, self.ids = k, [i for i, _ in items]
        self.words = [plain_words(text or "") for _, text in items]
        windows = [shingle_hashes(w, k) for w in self.words]
        h = np.concatenate(windows) if windows else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items), dtype=np.int32), [len(w) for w in windows])
        position = np.concatenate([np.arange(len(w), dtype=np.int32) for w in windows]) if windows else np.zeros(0, np.int32)
        order = np.lexsort((position, owner, h))
        h, owner, self.position = h[order], owner[order], position[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
        self.group_at = np.append(np.flatnonzero(new), len(h))  # a group: the positions of one seed in one item
        self.group_owner = owner[self.group_at[:-1]]
        first = h[self.group_at[:-1]]
        new = np.concatenate([[True], first[1:] != first[:-1]]) if len(first) else np.zeros(0, bool)
        self.key_at = np.append(np.flatnonzero(new), len(first))
        self.hashes = first[self.key_at[:-1]]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of windows that are seeds, and which seed."""
        if not len(self.hashes) or not len(windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[(windows >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        where = np.searchsorted(self.hashes, windows[at])
        where[where == len(self.hashes)] = 0
        same = self.hashes[where] == windows[at]
        return at[same], where[same]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [first, last): the range of each element, and the elements."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def tile(p: np.ndarray, q: np.ndarray, k: int) -> int:
    """Words of the item marked by greedy tiling; p, q: document and item positions of equal k-word windows."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    new = np.concatenate([[True], (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1)])
    starts = np.flatnonzero(new)
    sizes = np.diff(starts, append=len(p)) + k - 1
    heap = list(zip((-sizes).tolist(), p[starts].tolist(), q[starts].tolist(), strict=True))
    heapq.heapify(heap)
    doc_used: set[int] = set()
    item_used: set[int] = set()
    while heap:
        n, p, q = heapq.heappop(heap)
        free = [p + i not in doc_used and q + i not in item_used for i in range(-n)]
        if all(free):
            doc_used.update(range(p, p - n))
            item_used.update(range(q, q - n))
            continue
        start = None
        for i, ok in enumerate([*free, False]):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i - start >= k:
                    heapq.heappush(heap, (start - i, p + start, q + start))
                start = None
    return len(item_used)


def tile_by_length(doc: np.ndarray, item: np.ndarray, k: int) -> int:
    """As tile, from the words' hashes: each longest common run of unmarked words is found by bisecting its length over rolling hashes."""
    step = np.uint64(STEP)
    sums = []
    for words in (doc, item):
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words), step)]))
        inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words), np.uint64(pow(STEP, -1, 1 << 64)))]))
        sums.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1])]), inverse))
    used = [np.zeros(len(doc), bool), np.zeros(len(item), bool)]

    def windows(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of n unmarked words."""
        total, inverse = sums[side]
        marked = np.concatenate([[0], np.cumsum(used[side])])
        starts = np.flatnonzero(marked[n:] == marked[:-n])
        return starts, (total[starts + n] - total[starts]) * inverse[starts]

    def common(n: int) -> tuple[int, int] | None:
        """The first place in the document, and in the item, of a shared run."""
        (p, a), (q, b) = windows(0, n), windows(1, n)
        hit = np.flatnonzero(np.isin(a, b))
        if not len(hit):
            return None
        return int(p[hit[0]]), int(q[np.flatnonzero(b == a[hit[0]])[0]])

    longest = min(len(doc), len(item))
    while longest >= k and (at := common(k)):
        low, high = k, longest + 1
        while high - low > 1:
            mid = (low + high) // 2
            if found := common(mid):
                low, at = mid, found
            else:
                high = mid
        used[0][at[0] : at[0] + low] = True
        used[1][at[1] : at[1] + low] = True
        longest = low
    return int(used[1].sum())


def seeds_by_length(items: list[tuple[int | None, str]], k: int) -> list[Seeds]:
    """Seeds of k words, and of fewer for the items that are shorter."""
    groups: dict[int, list[tuple[int | None, str]]] = {k: []}
    for item in items:
        groups.setdefault(min(k, len(plain_words(item[1])) or k), []).append(item)
    return [Seeds(g, n) for n, g in groups.items()]


def _shares(s: Seeds, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(document, item, marked share of the item) of all pairs that share a window. words, doc: hash and document of each word."""
    at, key = s.hits(shingle_hashes(words, s.k))
    inside = doc[at] == doc[at + s.k - 1] if len(at) else np.zeros(0, bool)
    at, key = at[inside], key[inside]
    of = doc[at]
    # whole documents at a time, of about EXPAND windows times items
    reach = np.cumsum(s.key_at[key + 1] - s.key_at[key])
    ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)) if len(of) else np.zeros(0, np.int64)
    begin = 0
    while begin < len(at):
        done = reach[begin - 1] if begin else 0
        end = int(ends[max(np.searchsorted(ends, np.searchsorted(reach, done + EXPAND, "right"), "right") - 1, np.searchsorted(ends, begin, "right"))])
        hit, group = _spread(s.key_at[key[begin:end]], s.key_at[key[begin:end] + 1])
        hit += begin
        pair = of[hit].astype(np.int64) * len(s.ids) + s.group_owner[group]
        order = np.argsort(pair, kind="stable")
        hit, group, pair = hit[order], group[order], pair[order]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pair)], strict=True):
            d, n = divmod(int(pair[a]), len(s.ids))
            low, high = s.group_at[group[a:b]], s.group_at[group[a:b] + 1]
            if (high - low).sum() > MANY_PAIRS:
                marked = tile_by_length(words[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")], s.words[n], s.k)
            else:
                which, places = _spread(low, high)
                marked = tile(at[hit[a:b]][which], s.position[places].astype(np.int64), s.k)
            yield d, n, marked / len(s.words[n])
        begin = end


def _better(a: tuple[float, int | None], b: tuple[float, int | None]) -> tuple[float, int | None]:
    return max(a, b, key=lambda x: (x[0], x[1] is not None, -(x[1] or 0)))


def _scan_batches(seeds, threshold: float, carry: bool = False):
    """Adds a block's findings to those of the blocks before, if any; carry: with the text, for the next block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode().lower().translate(PLAIN) for t in batch.column("text")]
            later = "items" in batch.schema.names
            items: list[list[int]] = batch.column("items").to_pylist() if later else [[] for _ in texts]
            best: list[tuple[float, int | None]] = list(zip(batch.column("coverage").to_pylist(), batch.column("best_item").to_pylist(), strict=True)) if later else [(0.0, None)] * len(texts)
            for first, last in chunks(texts):
                data, begins = joined(texts[first:last])
                words, starts, _ = word_hashes(data, data != 32)
                doc = np.searchsorted(begins, starts, "right") - 1
                for s in seeds.value:
                    for d, n, share in _shares(s, words, doc):
                        best[first + d] = _better(best[first + d], (share, s.ids[n]))
                        if share >= threshold:
                            items[first + d].append(s.ids[n])
            columns = [batch.column("doc_id"), pa.array([sorted(x, key=lambda i: (i is None, i or 0)) for x in items], pa.list_(pa.int64())), pa.array([b[0] for b in best], pa.float64()), pa.array([b[1] for b in best], pa.int64())]
            names = ["doc_id", "items", "coverage", "best_item"]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("text")], [*names, "text"]) if carry else pa.RecordBatch.from_arrays(columns, names)

    return scan


def _blocks(docs: DataFrame, benchmark: DataFrame, min_match: int) -> Iterator[tuple[Broadcast, bool]]:
    """Seeds of each block of items, one broadcast at a time, and whether it is the last."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    seeds = None
    for b in range(n):
        if seeds is not None:
            seeds.destroy()  # its pass has been written
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        rows = sorted(((r[0], r[1]) for r in block), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        seeds = spark.sparkContext.broadcast(seeds_by_length(rows, min_match))
        yield seeds, b + 1 == n


def _keep_batches(seeds, threshold: float, text_at: int):
    scan = _scan_batches(seeds, threshold)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(scan(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_at)], ["doc_id", "text"])])))
            yield batch.filter(pa.array([not x for x in found.column(1).to_pylist()], pa.bool_()))

    return keep


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs without the contaminated documents: whole rows pass through, nothing is shuffled."""
    scratch = Scratch(docs.sparkSession, "tiles")
    for i, (seeds, last) in enumerate(_blocks(docs, benchmark, min_match)):
        docs = docs.mapInArrow(_keep_batches(seeds, threshold, docs.columns.index(text_col)), docs.schema)
        if not last:
            docs = scratch.save(docs, f"kept_{i}")
            scratch.drop(f"kept_{i - 1}")
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, items (covered to the threshold), coverage and best_item of every document."""
    scratch = Scratch(docs.sparkSession, "tiles")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for i, (seeds, last) in enumerate(_blocks(docs, benchmark, min_match)):
        out = out.mapInArrow(_scan_batches(seeds, threshold, not last), SCHEMA + ", text string" * (not last))
        if not last:
            out = scratch.save(out, f"found_{i}")
            scratch.drop(f"found_{i - 1}")
    return out
