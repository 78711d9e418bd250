"""MinHash near-dedup.

Every document's set of 5-word shingles is reduced to BANDS x ROWS minima of universal
hash functions. Documents with equal sets form a class, its smallest doc_id stands for
it. Class representatives that agree on all rows of a band share a bucket. In each
bucket the signatures' estimate, far below the threshold by its own error, decides which
members may be near; the spanning edges of that relation give families, by large-star
and small-star. Within a family links are confirmed on the full shingle sets, and the
components of the confirmed links are the result.

Large buckets and families are dealt in blocks of bounded size. Blocks that fell together
send one head each to meet the others, and only members outside their group's largest
component go on to meet all blocks, so a group of copies costs linear work and no pair is
left out but those known to be connected. A link at the threshold 0.8 shares no band with probability (1 - 0.8^4)^32, 5e-8,
and falls below the estimate's margin of 5 standard errors with probability 3e-7.

Defined cases: a text without words, or null, has no shingles and links with nothing;
with fewer words than a shingle the whole sequence is one shingle; rows with an equal
doc_id are taken as copies of one document (their shingles, if they differ, are separate
members under the same id); rows with a null doc_id are documents of their own after all
others: they come back with the component of the smallest real doc_id they reach, or null,
and of a group without any real one a single row is kept; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, bounded_batches
from docspark.llm.components import components
from docspark.llm.textnum import ASCII_SPACE, chunks, joined, mix, shingle_hashes, word_hashes

SHINGLE, BANDS, ROWS = 5, 32, 4
HASHES = BANDS * ROWS
#: Members of a bucket, and shingles of a family, that one task holds at a time.
BUCKET_BLOCK, FAMILY_BLOCK = 16_384, 1 << 19
#: Rows with a null id are numbered from here.
NULL_IDS = 1 << 62
_RNG = np.random.default_rng(7)
MUL = _RNG.integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
SIGNATURE_SCHEMA = "doc_id long, n_shingles long, digest binary, sketch binary, bands array<long>"


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode().lower() for t in texts]
    for first, last in chunks(raw):
        data, begins = joined(raw[first:last])
        words, starts, _ = word_hashes(data, ~ASCII_SPACE[data])
        cuts = np.searchsorted(starts, begins)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            yield np.unique(shingle_hashes(words[a:b], min(k, b - a)) ^ np.uint64(min(k, b - a))) if b > a else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """High 32 bits of the least of (a x + b) mod 2^64 over the set, for each hash function."""
    out = np.empty(HASHES, np.uint64)
    for i in range(HASHES):
        out[i] = (shingles * MUL[i] + ADD[i]).min()
    return (out >> np.uint64(32)).astype(np.uint32)


def _sign_batches(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, sketches, bands = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), k):
                counts.append(len(s))
                if not len(s):
                    digests.append(None)
                    sketches.append(None)
                    bands.append(None)
                    continue
                sig = signature(s)
                rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
                key = np.arange(BANDS, dtype=np.uint64)
                for j in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketches.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sketch", "bands"])

    return sign


def near_edges(ids: list[int], groups: list[int | None], near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[tuple[int, int]], list[int]]:
    """A spanning forest of the relation, and the first member of each member's tree.

    Breadth-first, each member meets only those not reached yet. Members of one group (None:
    alone) are known to be connected and are not compared.
    """
    own = np.array([i if g is None else g for i, g in zip(ids, groups, strict=True)])
    left = np.arange(len(ids))
    edges, heads = [], [0] * len(ids)
    while len(left):
        first = int(left[0])
        frontier, left = [first], left[1:]
        while frontier:
            at = frontier.pop()
            heads[at] = ids[first]
            if not len(left):
                continue
            same = own[left] == own[at]
            frontier += left[same].tolist()
            left = left[~same]
            yes = near(at, left)
            reached = left[yes]
            edges += [(ids[at], ids[x]) for x in reached.tolist()]
            frontier += reached.tolist()
            left = left[~yes]
    return edges, heads


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The first n_keys columns, which come sorted, and the rows that share them."""
    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


FOUND = "g long, u long, v long, label boolean"


def _found_batches(found: Iterator[tuple[int, int, int, bool]], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("g", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("label", pa.bool_())])
    while part := list(islice(found, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _meeting(relation: Callable[[list[tuple]], Callable]):
    """Edges among the rows (g, bi, bj, parts, rep, comp, payload) of each pair of blocks; and each member's tree where parts, the group's blocks, are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (g, _, _, parts), rows in _groups(batches, 4):
                if len(rows) == 1:
                    if parts > 1:
                        yield g, rows[0][0], rows[0][0], True
                    continue
                ids = [r[0] for r in rows]
                edges, heads = near_edges(ids, [r[1] for r in rows], relation([r[2:] for r in rows]))
                yield from ((g, u, v, False) for u, v in edges)
                if parts > 1:
                    yield from ((g, u, v, True) for u, v in zip(ids, heads, strict=True))

        yield from _found_batches(found())

    return run


def _alike(least_equal: int):
    """Members whose sketches agree in so many places. payload: sketch."""

    def relation(rows: list[tuple]) -> Callable:
        sketch = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(len(rows), HASHES)
        return lambda at, left: (sketch[left] == sketch[at]).sum(1) >= least_equal

    return relation


def _linked(k: int, percent: int, least_equal: int):
    """Members whose full sets are similar. payload: sketch, text."""

    def relation(rows: list[tuple]) -> Callable:
        sketch = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(len(rows), HASHES)
        sets = list(shingle_sets([r[1] for r in rows], k))
        sizes = np.array([len(s) for s in sets])

        def near(at: int, left: np.ndarray) -> np.ndarray:
            a, n = sets[at], sizes[at]
            yes = (sketch[left] == sketch[at]).sum(1) >= least_equal
            yes &= np.minimum(sizes[left], n) * 100 >= percent * np.maximum(sizes[left], n)
            for i in np.flatnonzero(yes).tolist():
                b = sets[left[i]]
                where = np.searchsorted(a, b)
                where[where == len(a)] = 0
                common = int((a[where] == b).sum())
                yes[i] = 100 * common >= percent * (n + len(b) - common)
            return yes

        return near

    return relation


def spanning_links(scratch: Scratch, name: str, members: DataFrame, payload: list[str], block: int, relation: Callable) -> DataFrame:
    """Links (u, v) whose components are those of the relation within each group of members (g, rep, weight, payload).

    Every member meets its own block of its group, of weight about block. Where a group has
    several blocks, their trees send one head each, and the heads meet in pairs of blocks. Where
    it still has more than one component, the members of all but the largest meet every block. A
    pair is left out only if it is known to be connected, so the work on a group of copies is
    linear, and nobody's partners are capped.
    """

    def meet(rows: DataFrame) -> DataFrame:
        dealt = ["g", "bi", "bj"]
        return rows.select(*dealt, "parts", "rep", "comp", *payload).repartition(*dealt).sortWithinPartitions(*dealt).mapInArrow(_meeting(relation), FOUND)

    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    none = F.lit(None).cast("long")
    sizes = members.groupBy("g").agg(F.sum("weight").alias("__w"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    parts = sizes.select(F.col("g").alias("__g"), F.ceil(F.col("__w") / F.lit(block)).cast("long").alias("parts"))
    dealt = members.join(parts, F.col("g") == F.col("__g")).withColumn("bi", own).withColumn("bj", own).withColumn("comp", none)
    first = scratch.save(meet(dealt), f"{name}_first")
    links = first.where("NOT label").select("u", "v")
    labels = first.where("label").select(F.col("g").alias("__g"), F.col("u").alias("__rep"), F.col("v").alias("head"))
    heads = labels.groupBy("__g", "head").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.join(members.select("g", "rep", "weight"), (F.col("__g") == F.col("g")) & (F.col("head") == F.col("rep"))).select("__g", "head", "n", F.col("weight").alias("w"))
    heads = scratch.save(heads, f"{name}_heads")
    many = heads.groupBy(F.col("__g").alias("__of")).agg(F.count(F.lit(1)).alias("__h"), F.ceil(F.sum("w") / F.lit(block)).cast("long").alias("parts")).where("__h > 1").drop("__h")
    if not many.limit(1).count():
        return links

    met = heads.join(many, F.col("__g") == F.col("__of")).join(members, (F.col("__g") == F.col("g")) & (F.col("head") == F.col("rep")))
    met = met.withColumn("__own", own).withColumn("__other", F.explode(every)).withColumn("comp", none)
    met = met.withColumn("bi", F.least("__own", "__other")).withColumn("bj", F.greatest("__own", "__other"))
    second = scratch.save(meet(met.withColumn("parts", F.lit(1).cast("long"))).select("u", "v"), f"{name}_second")
    links = links.unionByName(second)

    of = components(scratch, second, f"{name}_joined")
    told = heads.join(of, F.col("head") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "head")).drop("node", "component")
    told = scratch.save(told, f"{name}_told")
    sums = told.groupBy("__g", "comp").agg(F.sum("n").alias("n")).groupBy(F.col("__g").alias("__of"))
    left = sums.agg(F.max(F.struct("n", "comp"))["comp"].alias("__largest"), F.count(F.lit(1)).alias("__comps")).where("__comps > 1").select("__of", "__largest")
    left = scratch.save(left, f"{name}_left")
    if not left.limit(1).count():
        return links
    rows = labels.join(told.select(F.col("__g").alias("__in"), F.col("head").alias("__head"), "comp"), (F.col("__g") == F.col("__in")) & (F.col("head") == F.col("__head")))
    rows = rows.join(left, F.col("__g") == F.col("__of")).select("__g", "__rep", "comp", "__largest")
    rows = rows.join(members, (F.col("__g") == F.col("g")) & (F.col("__rep") == F.col("rep"))).drop("__g").join(parts, F.col("g") == F.col("__g"))
    rows = rows.withColumn("bi", F.explode(F.when(F.col("comp") == F.col("__largest"), F.array(own)).otherwise(every))).withColumn("bj", F.col("bi"))
    return links.unionByName(meet(rows.withColumn("parts", F.lit(1).cast("long"))).select("u", "v"))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links need 100 |A and B| >= percent |A or B|."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "minhash")
    slim, _ = numbered(scratch, docs, id_col, text_col)
    return _classes(scratch, slim, percent, shingle).select(F.when(F.col("doc_id") < NULL_IDS, F.col("doc_id")).alias("doc_id"), "n_shingles", F.when(F.col("component_id") < NULL_IDS, F.col("component_id")).alias("component_id"), "kept")


def keep_one(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that near_duplicates doesn't keep."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "minhash")
    slim, nulls = numbered(scratch, docs, id_col, text_col)
    gone = scratch.save(_classes(scratch, slim, percent, shingle).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    real = docs.where(F.col(id_col).isNotNull()).join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    return real.unionByName(nulls.join(gone, F.col("__id") == F.col("__gone"), "left_anti").select("__row.*"))


def numbered(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, text of every row; and the rows with a null id, __row under __id, written once so that their numbers hold."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    number = (F.lit(NULL_IDS) + F.monotonically_increasing_id()).alias("__id")
    nulls = scratch.save(docs.where(F.col(id_col).isNull()).select(number, F.col(text_col).alias("__text"), row), "null_ids")
    real = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return real.unionByName(nulls.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text"))), nulls


def _classes(scratch: Scratch, slim: DataFrame, percent: int, shingle: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; no id is null."""
    signed = scratch.save(slim.mapInArrow(_sign_batches(shingle), SIGNATURE_SCHEMA), "signatures")
    # classes of equal sets; sketches and bands of a class are all alike
    classes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"))
    classes = scratch.save(classes, "classes")
    reps = signed.join(classes.select(F.col("digest").alias("__g"), "rep", "n"), (F.col("digest") == F.col("__g")) & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["digest", "rep"]).select("rep", "n", "sketch", "bands")
    reps = scratch.save(reps, "reps")
    band = reps.select("rep", F.explode("bands").alias("key"))
    buckets = band.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    mean = percent / 100
    least = mean + (1 - mean) / 256
    least_equal = max(1, int(HASHES * (least - 5 * (least * (1 - least) / HASHES) ** 0.5)))
    # sketches join only the few rows whose bucket has company; a band's number is mixed into its key
    shared = band.join(buckets.select("key"), "key").join(reps.select("rep", "sketch"), "rep")
    shared = scratch.save(shared.select(F.col("key").alias("g"), "rep", F.lit(1).alias("weight"), "sketch"), "shared")
    likely = spanning_links(scratch, "likely", shared, ["sketch"], BUCKET_BLOCK, _alike(least_equal))
    family = scratch.save(components(scratch, likely, "family"), "families")
    members = family.join(reps.select("rep", "n", "sketch"), F.col("node") == F.col("rep")).join(slim, F.col("node") == F.col("doc_id"))
    # written once: large families' members meet more than once, the corpus is shuffled once
    members = scratch.save(members.select(F.col("component").alias("g"), "rep", F.col("n").alias("weight"), "sketch", "text"), "members")
    links = spanning_links(scratch, "exact", members, ["sketch", "text"], FAMILY_BLOCK, _linked(shingle, percent, least_equal))
    found = scratch.save(components(scratch, links, "links").where("node != component"), "components")
    by_class = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("__digest"), F.coalesce("component", "rep").alias("__component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(by_class, F.col("digest") == F.col("__digest"), "left")
    component = F.coalesce("__component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
