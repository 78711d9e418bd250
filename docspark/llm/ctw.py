"""LM scoring by context-tree weighting.

A byte is coded as 8 binary decisions, each with a context tree over the DEPTH bytes
before it. Every node holds the Krichevsky-Trofimov estimate of its 0/1 counts, and a
node's weighted probability halves its own estimate and the product of its children's:
all depths are mixed. After training, a bit's probability follows from the root down by
each node's posterior weight for its children. Every text ends with the byte 0xFF, which
UTF-8 never holds, so the probabilities of all texts add up to one.

Documents are packed in blocks. A block asks for the distinct words and byte strings
(context, byte) it holds, with their training counts, in cells dealt by a hash of the word
or of the three bytes before the byte. The cells of a part are summed in two steps, first
by runs of blocks (salts), so neither a common word nor a common byte string brings all
blocks to one task. Each part builds the subtrees below its triples of bytes, at most
256 ** (DEPTH - 2) strings each; the levels above are summed by pair, by byte and, from at
most 65,280 nodes, on the driver. The code lengths then go back the same way: part by part
and salt by salt to the blocks. Nothing of the size of the vocabulary is broadcast, and no
task holds more than one part's distinct keys and one block.

Texts are lower-cased (A-Z) for both models. Contexts before the first byte are zeros.
The base model is the smoothed unigram over words and one end per document.

Defined cases: a null text is empty: its only token is the end; a null doc_id is trained
on as the id of the empty string; equal rows count one by one; without any training
documents every count is 0 and every bit has probability 1/2; an empty table gives an
empty result; further columns are ignored. Texts are cut in pieces of a megabyte, words in
whole, so memory grows with the longest text and not with its arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, bounded_batches
from docspark.llm.textnum import ASCII_SPACE, mix, space_cut, word_hashes
from docspark.sources.parts import input_parts

DEPTH = 5
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
SALT_BLOCKS = 4096
SUBTREE_KEYS = 1 << 15
PENDING_KEYS = 1 << 20
END = b"\xff"
WORDS, GRAMS, DOCS = 0, 1, 2
CELL = "kind int, part int, keys binary, counts binary"
BLOCK_SCHEMA = f"block long, docs binary, cells array<struct<{CELL.replace(' ', ':').replace(',:', ',')}>>, train_docs long"
MODEL_SCHEMA = f"{CELL}, pairs array<struct<pair:int,nodes:binary>>, tokens long, types long"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes behind its length."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return len(a).to_bytes(4, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(b: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(b[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[4:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


# the keys of a block


def gram_pieces(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(strings, document of each) of every byte and end. A string's bytes, most significant first: the last byte before, the one before that, .., the byte itself."""
    parts, docs, size = [], [], 0

    def flush():
        data = np.frombuffer(b"".join(parts), np.uint8)
        keys = data[depth:].astype(np.uint64)
        for i in range(1, depth + 1):
            keys |= data[depth - i : len(data) - i].astype(np.uint64) << np.uint64(8 * (depth - i + 1))
        real = np.ones(len(data), bool)
        begins = np.cumsum([0, *(len(p) for p in parts[:-1])])
        for j in range(depth):
            real[begins + j] = False
        return keys[real[depth:]], np.repeat(docs, [len(p) - depth for p in parts])

    for i, t in enumerate(texts):
        whole = bytes(depth) + t + END
        for a in range(0, len(t) + 1, PIECE_BYTES):
            piece = whole[a : a + depth + PIECE_BYTES]
            parts.append(piece)
            docs.append(i)
            size += len(piece)
            if size >= PIECE_BYTES:
                yield flush()
                parts, docs, size = [], [], 0
    if parts:
        yield flush()


def word_pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, document of each) of every word."""
    parts, docs, size = [], [], 0

    def flush():
        data = np.frombuffer(b" ".join(parts), np.uint8)
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        h, starts, _ = word_hashes(data, ~ASCII_SPACE[data])
        return h, np.asarray(docs)[np.searchsorted(begins, starts, "right") - 1]

    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = space_cut(t, at + PIECE_BYTES)
            parts.append(t[at:end])
            docs.append(i)
            size, at = size + end - at + 1, end
            if size >= PIECE_BYTES:
                yield flush()
                parts, docs, size = [], [], 0
    if parts:
        yield flush()


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[starts], np.add.reduceat(c, starts) if len(k) else c


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(starts, append=len(keys))


def counted(pieces: Iterable[tuple[np.ndarray, np.ndarray]], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all documents, with their counts in training documents."""
    keys, counts = [], []
    for k, doc in pieces:
        t = train[doc]
        for part, times in ((k[t], 1), (k[~t], 0)):
            one, n = _runs(part)
            keys.append(one)
            counts.append(n * times)
    return summed(keys, counts)


class Lookup:
    """Where keys stand among sorted distinct ones: by a hash table, and by bisection where two share a slot."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - min(24, len(keys).bit_length() + 3))
        self.table = np.zeros(1 << 64 - int(self.shift), np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys) if len(keys) else at
        at[miss] = np.searchsorted(self.keys, keys[miss])
        return at


def parts_of(kind: int, keys: np.ndarray, n: int, depth: int) -> np.ndarray:
    """A key's part; strings with the same three last bytes of context share one."""
    return (mix(keys >> np.uint64(8 * (depth - 2))) if kind == GRAMS else keys) % np.uint64(n)


def cells(kind: int, keys: np.ndarray, n: int, depth: int) -> list[tuple[int, np.ndarray]]:
    """(part, indexes of its keys in order)."""
    part = parts_of(kind, keys, n, depth)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n + 1, dtype=np.uint64))
    return [(p, order[a:b]) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if b > a]


def _lower(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode().lower() for t in texts]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in blocks of about BLOCK_BYTES; a longer text stands alone."""
    rows, size = [], 0
    for batch in batches:
        first = 0
        for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
            if size and size + (n or 0) > BLOCK_BYTES:
                yield pa.Table.from_batches([*rows, batch.slice(first, i - first)])
                rows, size, first = [], 0, i
            size += n or 0
        rows.append(batch.slice(first))
    if sum(r.num_rows for r in rows):
        yield pa.Table.from_batches(rows)


def _block_batches(n_parts: int, depth: int):
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, docs in enumerate(_slices(batches), TaskContext.get().partitionId() << 32):
            texts = _lower(docs.column(1).to_pylist())
            train = np.array([not held_out(i) for i in docs.column(0).to_pylist()])
            out = []
            for k, pieces in ((WORDS, word_pieces(texts)), (GRAMS, gram_pieces(texts, depth))):
                keys, counts = counted(pieces, train)
                out += [{"kind": k, "part": p, "keys": pack_keys(keys[at]), "counts": pack(counts[at])} for p, at in cells(k, keys, n_parts, depth)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(docs)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([out], kind), pa.array([int(train.sum())], pa.int64())], ["block", "docs", "cells", "train_docs"])

    return run


# trees


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2: seven steps up, then Stirling's series."""
    up = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4)) + np.log((x + 5) * (x + 6))
    y = x + 7.0
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - up


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """Nodes of one depth: key (context << 8 | 1 before the bit prefix), counts, weighted log probability.

    one is the node's own probability of a one, down its weight for its children.
    """

    def __init__(self, keys, n0, n1, children=None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        own = kt_log(n0, n1)
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)
        if children is None:
            self.log_w, self.down = own, np.zeros(len(keys))
        else:
            self.log_w = np.logaddexp(own, children) - np.log(2)
            self.down = 1 / (1 + np.exp(np.clip(own - children, -700, 700)))

    def up(self) -> tuple[Level, np.ndarray]:
        """The level above, and each node's parent in it."""
        keys, at = np.unique(parents(self.keys), return_inverse=True)
        total = lambda x: np.bincount(at, x, len(keys))
        return Level(keys, total(self.n0), total(self.n1), total(self.log_w)), at

    def mixed(self, above: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of each node, where a + b * p is the probability of a one if the children's mixture is p. above: the parents' (a, b)."""
        a, b = above
        return a + b * (1 - self.down) * self.one, b * self.down


def parents(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)


def leaves(keys: np.ndarray, counts: np.ndarray) -> tuple[Level, list[np.ndarray]]:
    """Nodes of full depth from sorted strings and their counts, and each string's node for each of its 8 bits."""
    nodes, zeros, ones, at, n = [], [], [], [], 0
    counts = counts.astype(float)
    for j in range(8):
        head = keys >> np.uint64(8 - j)
        first = np.concatenate([[True], head[1:] != head[:-1]])
        starts = np.flatnonzero(first)
        n1 = np.add.reduceat(counts * (keys >> np.uint64(7 - j) & np.uint64(1)), starts)
        nodes.append(head[starts] >> np.uint64(j) << np.uint64(8) | np.uint64(1 << j) | head[starts] & np.uint64((1 << j) - 1))
        ones.append(n1)
        zeros.append(np.add.reduceat(counts, starts) - n1)
        at.append(np.cumsum(first) - 1 + n)
        n += len(starts)
    return Level(np.concatenate(nodes), np.concatenate(zeros), np.concatenate(ones)), at


def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[tuple[slice, list[np.ndarray], list[Level], list[np.ndarray]]]:
    """Runs of whole triples: the strings' slice, their bits' leaves, levels from depth down to 3, and each level's parents."""
    triple = keys >> np.uint64(8 * (depth - 2))
    ends = np.append(np.flatnonzero(triple[1:] != triple[:-1]) + 1, len(keys))
    first = 0
    while first < len(keys):
        last = int(ends[max(np.searchsorted(ends, first + SUBTREE_KEYS, "right") - 1, np.searchsorted(ends, first, "right"))])
        level, at = leaves(keys[first:last], counts[first:last])
        levels, ups = [level], []
        for _ in range(depth - 3):
            level, up = level.up()
            levels.append(level)
            ups.append(up)
        yield slice(first, last), at, levels, ups
        first = last


def codes(keys: np.ndarray, counts: np.ndarray, depth: int, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each string's byte after its context. pairs: sorted nodes of depth 2 with their (a, b)."""
    out = np.empty(len(keys), np.float32)
    for rows, at, levels, ups in subtrees(keys, counts, depth):
        where = np.searchsorted(pairs[0], parents(levels[-1].keys))
        ab = (pairs[1][where], pairs[2][where])
        for level, up in zip(levels[:0:-1], ups[::-1], strict=True):
            ab = level.mixed(ab)
            ab = (ab[0][up], ab[1][up])
        p = ab[0] + ab[1] * levels[0].one
        bits = keys[rows]
        total = np.zeros(len(bits))
        for j in range(8):
            q = p[at[j]]
            total += np.log10(np.where(bits >> np.uint64(7 - j) & np.uint64(1) == 1, q, 1 - q))
        out[rows] = total
    return out


def pack_nodes(level: Level, at: slice = slice(None)) -> bytes:
    return b"".join(np.ascontiguousarray(a[at]).tobytes() for a in (level.keys, level.n0, level.n1, level.log_w))


def unpack_nodes(payloads: list[bytes]) -> Level:
    """The nodes of all payloads in order of their keys."""
    columns = [np.concatenate(c) for c in zip(*(np.frombuffer(p, np.uint8).reshape(4, -1) for p in payloads), strict=True)] if payloads else [np.zeros(0, np.uint8)] * 4
    keys, rest = columns[0].view(np.uint64), [c.view(np.float64) for c in columns[1:]]
    order = np.argsort(keys, kind="stable")
    out = Level(keys[order], rest[0][order], rest[1][order])
    out.log_w = rest[2][order]
    return out


# passes


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _one(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def _merged(rows: Iterable[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of packed cells, a million pending keys at a time."""
    keys, counts, pending = [], [], 0
    for k, c in rows:
        keys.append(unpack_keys(k))
        counts.append(unpack(c, np.int64))
        pending += len(keys[-1])
        if len(keys) > 1 and pending > PENDING_KEYS:
            k, c = summed(keys, counts)
            keys, counts, pending = [k], [c], 0
    return summed(keys, counts)


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of one (kind, part, salt), which come together, as one cell."""
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    for (kind, part, _), rows in groupby(_rows(batches), lambda r: r[:3]):
        keys, counts = _merged(r[3:] for r in rows)
        yield _one(schema, kind, part, pack_keys(keys), pack(counts))


def _model_batches(depth: int):
    """The final counts of a part, and of its strings the depth-3 nodes by their pair of last bytes."""
    pair = pa.struct([("pair", pa.int32()), ("nodes", pa.binary())])
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("pairs", pa.list_(pair)), ("tokens", pa.int64()), ("types", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, part), rows in groupby(_rows(batches), lambda r: r[:2]):
            keys, counts = _merged(r[2:] for r in rows)
            pairs, tokens, types = [], int(counts.sum()), int((counts > 0).sum())
            if kind == GRAMS:
                tokens = types = 0
                for _, _, levels, _ in subtrees(keys, counts, depth):
                    three = levels[-1]
                    of = three.keys >> np.uint64(16)
                    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
                    pairs += [{"pair": int(of[a]), "nodes": pack_nodes(three, slice(a, b))} for a, b in zip(cuts, cuts[1:], strict=False)]
            yield _one(schema, kind, part, pack_keys(keys), pack(counts), pairs, tokens, types)

    return run


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of last bytes: its parts and its depth-2 nodes, with what the depth-1 nodes need of them."""
    schema = pa.schema([("pair", pa.int32()), ("parts", pa.list_(pa.int32())), ("nodes", pa.binary()), ("mixture", pa.binary())])
    for pair, rows in groupby(_rows(batches), lambda r: r[0]):
        rows = list(rows)  # at most 256 x 255 nodes
        two, _ = unpack_nodes([r[2] for r in rows]).up()
        yield _one(schema, pair, sorted({r[1] for r in rows}), pack_nodes(two), b"".join(x.tobytes() for x in (two.keys, two.one, two.down)))


def _byte_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The depth-1 nodes below each last byte."""
    schema = pa.schema([("nodes", pa.binary()), ("down", pa.binary())])
    for _, rows in groupby(_rows(batches), lambda r: r[0]):
        one, _ = unpack_nodes([r[1] for r in rows]).up()  # from at most 256 x 255 nodes
        yield _one(schema, pack_nodes(one), one.down.tobytes())


def top(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted depth-1 nodes with their (a, b). rows: nodes and weights of their children, by last byte."""
    rows = sorted(rows, key=lambda r: int.from_bytes(r[0][:8], "little"))
    ones = unpack_nodes([r[0] for r in rows])
    ones.down = np.frombuffer(b"".join(r[1] for r in rows), np.float64)
    root, up = ones.up()
    a, b = root.mixed((np.zeros(len(root.keys)), np.ones(len(root.keys))))
    return (ones.keys, *ones.mixed((a[up], b[up])))


def _code_batches(depth: int, above):
    """Values of a part's keys: counts of words, code lengths of strings. Pairs' rows (key: their part) come before the part's own."""
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, part), rows in groupby(_rows(batches), lambda r: r[:2]):
            nodes: list[tuple[np.ndarray, ...]] = []
            for _, _, is_model, keys, counts in rows:
                if not is_model:
                    raw = np.frombuffer(keys, np.uint8).reshape(3, -1)
                    nodes.append((raw[0].view(np.uint64), raw[1].view(np.float64), raw[2].view(np.float64)))
                    continue
                if kind == WORDS:
                    yield _one(schema, kind, part, keys, counts)
                    continue
                two_keys, one, down = (np.concatenate(c) for c in zip(*sorted(nodes, key=lambda x: int(x[0][0])), strict=True))
                order = np.argsort(two_keys, kind="stable")
                two_keys, one, down = two_keys[order], one[order], down[order]
                at = np.searchsorted(above.value[0], parents(two_keys))
                a, b = above.value[1][at], above.value[2][at]
                names = unpack_keys(keys)
                values = codes(names, unpack(counts, np.int64), depth, (two_keys, a + b * (1 - down) * one, b * down))
                yield _one(schema, kind, part, keys, pack(values))

    return run


def _reply_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's cell gets its values; the part's values (block null) come first."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])
    for (kind, part, _), rows in groupby(_rows(batches), lambda r: r[:3]):
        keys = values = None
        for _, _, _, block, asked, payload in rows:
            if block is None:
                keys, values = unpack_keys(asked), unpack(payload, np.int64 if kind == WORDS else np.float32)
            else:
                yield _one(schema, block, kind, part, pack(values[np.searchsorted(keys, unpack_keys(asked))]))


def _score_batches(n_parts: int, depth: int, tokens: int, types: int, train_docs: int):
    total = tokens + train_docs
    floor = total + 0.5 * (types + (train_docs > 0) + 1)
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(n, pa.int64()) for n in ("n_bytes", "n_tokens", "n_known", "train_tokens")], *[(n, pa.float64()) for n in ("base_score", "score", "bits_per_byte")]]

    def block(ids: list, texts: list[bytes], replies: dict[tuple[int, int], bytes]) -> pa.RecordBatch:
        n, sums = len(ids), {}
        for kind, pieces in ((WORDS, word_pieces), (GRAMS, lambda t: gram_pieces(t, depth))):
            one = [_runs(k) for k, _ in pieces(texts)]
            keys, _ = summed([k for k, _ in one], [c for _, c in one])
            values = np.zeros(len(keys))
            for p, at in cells(kind, keys, n_parts, depth):
                values[at] = unpack(replies[kind, p], np.int64 if kind == WORDS else np.float32)
            columns = [values] if kind == GRAMS else [np.ones(len(keys)), (values > 0).astype(float), np.log10((values + 0.5) / floor)]
            out = [np.zeros(n) for _ in columns]
            find = Lookup(keys) if len(keys) else None
            for k, doc in pieces(texts):  # cut again rather than kept
                at = find(k)
                for o, c in zip(out, columns, strict=True):
                    o += np.bincount(doc, c[at], n)
            sums[kind] = out
        n_words, known, base = sums[WORDS]
        score, n_bytes = sums[GRAMS][0], np.array([len(t) for t in texts], np.int64)
        columns = [ids, [held_out(i) for i in ids], n_bytes, n_words.astype(np.int64) + 1, known.astype(np.int64) + (train_docs > 0), np.full(n, total), base + np.log10((train_docs + 0.5) / floor), score, -score * np.log2(10) / (n_bytes + 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), lambda r: r[0]):
            replies: dict[tuple[int, int], bytes] = {}
            for _, kind, part, payload in rows:
                if kind != DOCS:
                    replies[kind, part] = payload
                    continue
                docs = pa.ipc.open_stream(payload).read_all()
                yield block(docs.column(0).to_pylist(), _lower(docs.column(1).to_pylist()), replies)

    return run


def score(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    depth: bytes of context, 4 to 6. bits_per_byte is the code length over the text's bytes and its end.
    """
    if not 4 <= depth <= 6:
        raise ValueError("depth is 4 to 6")
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ctw")
    n_parts = input_parts(docs)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.save(slim.mapInArrow(_block_batches(n_parts, depth), BLOCK_SCHEMA), "blocks")
    n_blocks, train_docs = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("train_docs"), F.lit(0))).first()
    salts = max(1, -(-n_blocks // SALT_BLOCKS))
    asked = blocks.select("block", F.inline("cells")).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))

    sums = asked.select("kind", "part", "salt", "keys", "counts").repartition(n_parts, "kind", "part", "salt").sortWithinPartitions("kind", "part", "salt").mapInArrow(_sum_batches, CELL)
    model = sums.repartitionById(n_parts, "part").sortWithinPartitions("kind", "part").mapInArrow(_model_batches(depth), MODEL_SCHEMA)
    model = scratch.save(model, "model")
    tokens, types = model.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()

    threes = model.select("part", F.inline("pairs")).select("pair", "part", "nodes").repartition("pair").sortWithinPartitions("pair", "part")
    pairs = scratch.save(threes.mapInArrow(_pair_batches, "pair int, parts array<int>, nodes binary, mixture binary"), "pairs")
    byte = F.shiftright("pair", 8).alias("byte")
    ones = pairs.select(byte, "nodes", "pair").repartition("byte").sortWithinPartitions("byte", "pair").select("byte", "nodes").mapInArrow(_byte_batches, "nodes binary, down binary")
    above = spark.sparkContext.broadcast(top([(bytes(r[0]), bytes(r[1])) for r in ones.collect()]))  # at most 256 x 255 nodes

    two = pairs.select(F.lit(GRAMS).alias("kind"), F.explode("parts").alias("part"), F.lit(False).alias("is_model"), F.col("mixture").alias("keys"), F.lit(None).cast("binary").alias("counts"))
    whole = model.select("kind", "part", F.lit(True).alias("is_model"), "keys", "counts").unionByName(two)
    valued = whole.repartitionById(n_parts, "part").sortWithinPartitions("kind", "part", "is_model").mapInArrow(_code_batches(depth, above), "kind int, part int, keys binary, values binary")
    valued = scratch.save(valued, "values").select("kind", "part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("block"), "keys", F.col("values").alias("payload"))
    both = asked.select("kind", "part", "salt", "block", "keys", F.lit(None).cast("binary").alias("payload")).unionByName(valued)
    both = both.repartition(n_parts, "kind", "part", "salt").sortWithinPartitions("kind", "part", "salt", F.asc_nulls_first("block"))
    replies = both.mapInArrow(_reply_batches, "block long, kind int, part int, payload binary")
    rows = replies.unionByName(blocks.select("block", F.lit(DOCS).alias("kind"), F.lit(0).alias("part"), F.col("docs").alias("payload")))
    return rows.repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(_score_batches(n_parts, depth, tokens, types, train_docs), SCORE_SCHEMA)
