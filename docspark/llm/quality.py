"""Quality rules with risk-controlled thresholds.

Fixed rules reject very short and very repetitive texts. The other rules' cutoffs are
chosen per stratum from labelled good documents. A hashed quarter of them orders all steps
(rule, cutoff) of a fixed grid by the documents each would lose, lenient before strict.
The other three quarters walk that path as a fixed sequence: each step tightens one rule,
and the exact binomial test rejects "all rules together lose more than the risk" when
P(X <= k | n, risk) <= delta / m, where k of the n documents would be lost to any rule. The
first step that fails ends the walk, so nothing is corrected over the grid; m counts the
strata, so with probability 1 - delta none loses more than the risk. Null strata and those
with too few labels to certify even a lossless step are pooled in one fallback stratum,
which unseen strata use too; if the pool is still too small, its learned rules are off.

Word repeats are counted inside the row: hashes of all 3-word windows are sorted, and
only texts with a repeat map them back to positions, so nothing is shuffled.

Defined cases: null text has no words and fails; labels for absent documents or with null quality are ignored; several
labels of a document count one by one; no labels at all leave the fixed rules; an empty
table gives an empty result; further columns are untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import SPACES, Scratch, let, strip_ascii, text_or_empty

SYMBOLS = "#*$%&|<>"
FEW_REPEATS = 64
BROADCAST_STRATA = 10_000
#: One in so many labelled documents orders the steps; the others certify them.
ORDERING = 4
#: Rules on share-like figures, and the grid of cutoffs from lenient to strict: reject above the cutoff.
RULES = ("symbol_share", "shout_share", "repeat_share", "dup_line_share", "mean_word")
GRID = {
    "symbol_share": (2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1),
    "shout_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "mean_word": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0),
}


def words(text: Column) -> Column:
    core = strip_ascii(text)
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+", -1))


def repeat_words(windows: Column) -> Column:
    """Words covered by windows (hashes of 3 words at each start) that occur at least twice."""
    return let(windows, lambda w: let(F.sort_array(w), lambda s: let(_twice(s), lambda t: F.when(F.size(t) == 0, 0).when(F.size(t) <= FEW_REPEATS, _cover(_few(w, t))).otherwise(_cover(_many(w)))))).cast("long")


def _twice(ordered: Column) -> Column:
    return F.array_distinct(F.filter(ordered, lambda h, i: (i > 0) & (h == F.get(ordered, i - 1))))


def _few(windows: Column, twice: Column) -> Column:
    at = F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i))
    return F.filter(at, lambda i: i.isNotNull())


def _many(windows: Column) -> Column:
    at = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda o, x, j: F.coalesce(F.get(o, j)["h"] == x["h"], F.lit(False))
    return let(at, lambda o: F.sort_array(F.transform(F.filter(o, lambda x, j: same(o, x, j - 1) | same(o, x, j + 1)), lambda x: x["i"])))


def _cover(starts: Column) -> Column:
    first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(starts, first, lambda a, s: F.struct((a["n"] + F.least(F.lit(3), s - a["last"])).alias("n"), s.alias("last")), lambda a: a["n"])


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts and rule figures of each text, and base_failed."""
    text = text_or_empty(text_col)
    grams = lambda w: F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    counts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(grams(w)).alias("r")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: strip_ascii(x) != "")
    dups = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    figures = F.struct(
        counts.alias("c"),
        dups.alias("d"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("upper"),
        F.char_length(F.regexp_replace(text, r"[^\p{L}]+", "")).alias("letters"),
    )
    step = docs.select("*", F.explode(F.array(figures)).alias("__f"))  # a generator: the optimizer won't compute the figures again for each use
    f = lambda name: F.col(f"__f.{name}")
    step = step.withColumns({"n_words": f("c.n"), "word_chars": f("word_chars"), "n_symbols": f("n_symbols"), "n_dup_lines": f("d.d"), "n_repeat_words": f("c.r")})
    one = lambda c: F.greatest(c, F.lit(1)).cast("double")
    step = step.withColumns(
        {
            "symbol_share": F.col("n_symbols") / one(F.col("n_words")),
            "shout_share": f("upper") / one(f("letters")),
            "repeat_share": F.col("n_repeat_words") / one(F.col("n_words")),
            "dup_line_share": F.col("n_dup_lines") / one(f("d.n")),
            "mean_word": F.col("word_chars") / one(F.col("n_words")),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    return step.drop("__f")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in logarithms by the ratio of neighbouring terms."""
    odds = F.lit(p / (1 - p))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i * odds)
        top = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["sum"] - top) + F.exp(term - top))).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.exp(F.aggregate(terms, start, step, lambda a: a["sum"])), F.lit(1.0))


def _own_strata(sizes: list[tuple[int, int]], pooled: bool, risk: float, delta: float) -> tuple[int, float]:
    """Labels from which a stratum is tested on its own, and the level of each test. sizes: (labels, strata of that size)."""
    left, own, least = sum(c for _, c in sizes), 0, 1 << 62
    for n, c in sorted(sizes, reverse=True):
        tests = own + c + (pooled or left > own + c)
        if n * math.log1p(-risk) > math.log(delta / tests):
            break
        own, least = own + c, n
    return least, delta / max(1, own + (pooled or left > own))


def cutoffs(labelled: DataFrame, stratum: str, risk: float, delta: float, key: Column | None = None) -> DataFrame:
    """stratum (null: the fallback) and one chosen cutoff per rule (null: off). labelled: rule figures of good documents; key deals them (none: by row)."""
    scratch = Scratch(labelled.sparkSession, "cutoffs")
    steps = [(r, i) for r in RULES for i in range(len(GRID[r]))]
    key = F.monotonically_increasing_id() if key is None else key
    # a document's first rejecting cutoff in each rule says all: the cells of these are few
    first = [sum(((F.col(r) <= c).cast("int") for c in GRID[r]), F.lit(0)).alias(f"__first_{r}") for r in RULES]
    dealt = labelled.select(F.col(stratum).alias("__stratum"), (F.pmod(F.xxhash64(key, F.lit("order")), F.lit(ORDERING)) == 0).alias("__orders"), *first)
    cells = scratch.save(dealt.groupBy(*dealt.columns).agg(F.count(F.lit(1)).alias("n")), "cells")
    held = F.when(~F.col("__orders"), F.col("n")).otherwise(0)
    strata = cells.groupBy("__stratum").agg(F.sum(held).alias("__held"))
    sizes = strata.groupBy(F.col("__stratum").isNull(), "__held").count().collect()  # distinct sizes: about the root of the labels
    least, level = _own_strata([(n, c) for null, n, c in sizes if not null], any(null for null, *_ in sizes), risk, delta)
    strata = strata.select("__stratum", F.when(F.col("__held") >= least, F.col("__stratum")).alias("__group"))
    cells = cells.withColumnRenamed("__stratum", "__of").join(strata, F.col("__of").eqNullSafe(F.col("__stratum")))

    lost = lambda r, i: F.sum(F.when(F.col("__orders") & (F.col(f"__first_{r}") <= i), F.col("n")).otherwise(0))
    path = cells.groupBy("__group").agg(F.sort_array(F.array(*[F.struct(lost(r, i).alias("k"), F.lit(i).alias("i"), F.lit(RULES.index(r)).alias("r")) for r, i in steps])).alias("__path"))
    at = lambda r, i: F.array_position(F.transform("__path", lambda x: x["r"] * 100 + x["i"]), F.lit(RULES.index(r) * 100 + i)).cast("int")
    path = path.select(F.col("__group").alias("__key"), *[F.array(*[at(r, i) for i in range(len(GRID[r]))]).alias(f"__at_{r}") for r in RULES])
    end = F.lit(len(steps) + 1)
    falls = F.least(*[F.coalesce(F.get(f"__at_{r}", F.col(f"__first_{r}")), end) for r in RULES])
    walk = cells.where(~F.col("__orders")).join(path, F.col("__group").eqNullSafe(F.col("__key"))).withColumn("__falls", falls)
    counts = [F.sum(F.when(F.col("__falls") <= t + 1, F.col("n")).otherwise(0)).alias(f"k{t}") for t in range(len(steps))]
    walk = walk.groupBy("__group").agg(F.sum("n").alias("n"), *counts)
    rows = walk.select("__group", "n", F.posexplode(F.array(*[f"k{t}" for t in range(len(steps))])).alias("t", "k"))
    # beyond its mean the tail is over one half, so only small k need summing
    passed = (F.col("k") <= F.col("n") * risk) & (binomial_tail(F.least(F.col("k"), (F.col("n") * risk).cast("long") + 1), F.col("n"), risk) <= level)
    good = rows.groupBy("__group").agg(F.coalesce(F.min(F.when(~passed, F.col("t"))), F.lit(len(steps))).alias("__good"))
    cut = lambda r: F.get(F.array(*[F.lit(c) for c in GRID[r]]), F.size(F.filter(f"__at_{r}", lambda p: p <= F.col("__good"))) - 1)
    chosen = path.join(good, F.col("__key").eqNullSafe(F.col("__group")), "left").select("__key", *[cut(r).alias(f"__cut_{r}") for r in RULES])
    return strata.where("__stratum IS NOT NULL").join(chosen, F.col("__group").eqNullSafe(F.col("__key"))).drop("__group", "__key").unionByName(chosen.where("__key IS NULL").withColumnRenamed("__key", "__stratum"))


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without the text unless keep_text) with metrics, base_failed and kept. labels: doc_id, quality (1 good)."""
    scratch = Scratch(docs.sparkSession, "quality")
    figures = metrics(docs, text_col)
    figures = scratch.save(figures if keep_text else figures.drop(text_col), "figures")
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("__id"))
    passed = figures.where(~F.col("base_failed")).select(F.col(id_col).alias("__doc"), F.col(stratum), *RULES)
    chosen = cutoffs(passed.join(good, F.col("__doc") == F.col("__id")), stratum, risk, delta, F.col("__doc"))
    chosen = scratch.save(chosen, "cutoffs")
    fallback = chosen.where("__stratum IS NULL").first()
    chosen = chosen.where("__stratum IS NOT NULL")
    if chosen.count() <= BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    joined = figures.join(chosen, F.col(stratum) == F.col("__stratum"), "left")
    bad = F.col("base_failed")
    for r in RULES:
        cut = F.when(F.col("__stratum").isNotNull(), F.col(f"__cut_{r}")).otherwise(F.lit(fallback and fallback[f"__cut_{r}"]).cast("double"))
        bad = bad | F.coalesce(F.col(r) > cut, F.lit(False))
    return joined.withColumn("kept", ~bad).drop("__stratum", *[f"__cut_{r}" for r in RULES])
