"""Personal data: overlapping candidates scored by gradient-boosted trees.

Generators of high recall propose spans: e-mail addresses, IP addresses, card numbers,
international phone numbers, any long digit string with separators, and any long token.
The first four are settled by their own tests (parts, Luhn, digit counts): a span that
passes is always redacted. All others get format and context features of small finite
domains. Depth-2 trees are boosted on the logistic loss over PLANTED lines of planted
personal data and look-alikes, of which a candidate is positive if it covers most of a
planted span and little else. A third of the lines trains the trees, another sets each
kind's cutoff, the lowest score at and above which PRECISION of the candidates are positive,
and the last is left for measuring (`report`). Candidates over the cutoff join the redactions.

Everything per row is a column expression in one pass over the table. Patterns use possessive
repeats and start only where a run starts, so their time is linear in the text and they never recurse.

Defined cases: null text is empty and has no spans; positions are code points, end
exclusive; equal rows give equal results; the control characters U+0001 and U+0002 are
ordinary characters of no kind; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import let, local_rows, text_or_empty
from docspark.llm.pii_truth import planted

KINDS = ("email", "ip", "card", "phone", "number", "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
}
NEEDS = {"email": "@", "phone": "+"}
FEATURES = ("kind", "length", "digits", "before", "after", "word", "mix")
SIZES = (len(KINDS), 5, 5, 5, 4, 3, 4)
ROUNDS, RATE, PRECISION, LEAST = 32, 0.3, 0.95, 20
#: Lines of planted truth: the bound of the training sample.
PLANTED = 9_000
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
CONTEXT = 16
NEAR = r"(?i)(?:mail|tel|phone|call|fax|mobil|card|visa|iban|account|host|addr|token|key|secret|passw|auth)"
OTHER_NUMBERS = r"(?i)(?:sha|md5|commit|revision|tree|parent|checksum|digest|etag|uuid|order|isbn|item|date|version|release|page|rows|number|no\.|base64|data|file)"
FOUND = "array<struct<start:int,end:int,m:string,before:string,after:string>>"


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places and surroundings: marks are put around them and the pieces' lengths added up."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)
    none = F.array().cast(FOUND)

    def add(a: Column, piece: Column) -> Column:
        n = F.instr(piece, CLOSE) - 1
        one = F.struct(a["at"].alias("start"), (a["at"] + n).alias("end"), F.substring(piece, F.lit(1), n).alias("m"), a["last"].alias("before"), F.substring(piece, n + 2, F.lit(1)).alias("after"))
        return F.struct((a["at"] + F.char_length(piece) - 1).alias("at"), F.right(F.concat(a["last"], F.translate(piece, CLOSE, "")), F.lit(CONTEXT)).alias("last"), F.concat(a["out"], F.array(one)).cast(FOUND).alias("out"))

    def walk(p: Column) -> Column:
        head = F.get(p, 0)
        start = F.struct(F.char_length(head).alias("at"), F.right(head, F.lit(CONTEXT)).alias("last"), none.alias("out"))
        return F.aggregate(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), start, add, lambda a: a["out"])

    return let(pieces, walk)


def luhn(digits: Column) -> Column:
    def step(a: Column, i: Column, r: Column) -> Column:
        d = F.substring(r, i, F.lit(1)).cast("int")
        two = d * 2
        return a + F.when(i % 2 == 1, d).when(two > 9, two - 9).otherwise(two)

    return let(F.reverse(digits), lambda r: F.aggregate(F.sequence(F.lit(1), F.char_length(r)), F.lit(0), lambda a, i: step(a, i, r)) % 10 == 0)


def passes(kind: str, m: Column) -> Column:
    """The kind's own test; digit strings and tokens have none."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\.", -1), lambda p: (F.char_length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(kind == "email")


def _bins(c: Column, *edges: int) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (c >= e).cast("int")
    return out


def _candidate(kind: str, x: Column) -> Column:
    m, before, after = x["m"], x["before"], x["after"]
    n, digits = F.char_length(m), F.char_length(F.regexp_replace(m, "[^0-9]", ""))
    last = F.right(before, F.lit(1))
    mix = F.when(~m.rlike("[A-Za-z]"), 0).when(m.rlike("^[0-9A-Fa-f]+$"), 1).when(m.rlike("[0-9]"), 2).otherwise(3)
    return F.struct(
        x["start"].alias("start"),
        F.lit(KINDS.index(kind)).alias("kind"),
        x["end"].alias("end"),
        passes(kind, m).alias("valid"),
        _bins(n, 10, 16, 24, 40).alias("length"),
        _bins(digits, 1, 9, 12, 16).alias("digits"),
        F.when(last == "", 0).when(last.rlike("[=:\"']"), 1).when(last == "+", 2).when(last.rlike("\\s"), 3).otherwise(4).alias("before"),
        F.when(after == "", 0).when(after.rlike("[\\s,.;]"), 1).when(after.rlike("[A-Za-z0-9]"), 2).otherwise(3).alias("after"),
        F.when(before.rlike(NEAR), 1).when(before.rlike(OTHER_NUMBERS), 2).otherwise(0).alias("word"),
        mix.alias("mix"),
    )


def _describe(kind: str):
    return lambda x: _candidate(kind, x)


CANDIDATES = "array<struct<start:int,kind:int,end:int,valid:boolean,length:int,digits:int,before:int,after:int,word:int,mix:int>>"


def candidates(text: Column) -> Column:
    """All generators' spans with validity and features; a generator runs only where its least sign is present."""
    none = F.array().cast(CANDIDATES)
    out = []
    for kind in KINDS:
        sign = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[A-Za-z0-9_/+=-]{20}" if kind == "secret" else "[0-9]")
        found = F.transform(find(text, PATTERNS[kind]), _describe(kind)).cast(CANDIDATES)
        out.append(F.when(sign, found).otherwise(none))
    return F.concat(*out)


def count_kind(a: Column, kind: int) -> Column:
    return F.size(F.filter(a, lambda c: c["kind"] == kind))


def _inside_valid(c: Column, all_: Column) -> Column:
    return F.exists(all_, lambda b: b["valid"] & (b["kind"] < 4) & (b["start"] <= c["start"]) & (b["end"] >= c["end"]))


def _tests() -> list[tuple[int, int, bool]]:
    """Splits (feature, value, ordered): feature <= value or feature == value."""
    out = []
    for f, size in enumerate(SIZES):
        ordered = FEATURES[f] in ("length", "digits")
        out += [(f, v, ordered) for v in range(size - ordered)]
    return out


def _goes(cell: tuple[int, ...], test: tuple[int, int, bool]) -> bool:
    f, v, ordered = test
    return cell[f] <= v if ordered else cell[f] == v


def fit(cells: list[tuple[tuple[int, ...], float, float]]) -> list:
    """Trees ((test, (test, yes, no), (test, yes, no))) from (features, count, positives) cells."""
    total, pos = sum(n for _, n, _ in cells), sum(p for _, _, p in cells)
    if not 0 < pos < total:
        return []
    prior, tests = math.log(pos / (total - pos)), _tests()
    same = (tests[0], prior, prior)
    scores, trees = [prior] * len(cells), [(tests[0], same, same)]  # the prior is a tree too
    side = {t: [_goes(c, t) for c, _, _ in cells] for t in tests}

    def best(rows: list[int], g: list[float], h: list[float]) -> tuple[float, tuple, float, float]:
        sg, sh = sum(g[i] for i in rows), sum(h[i] for i in rows)
        found = (-1.0, tests[0], 0.0, 0.0)
        for t in tests:
            yes = side[t]
            ag, ah = sum(g[i] for i in rows if yes[i]), sum(h[i] for i in rows if yes[i])
            gain = ag * ag / (ah + 1) + (sg - ag) ** 2 / (sh - ah + 1)
            if gain > found[0]:
                found = (gain, t, RATE * ag / (ah + 1), RATE * (sg - ag) / (sh - ah + 1))
        return found

    everything = list(range(len(cells)))
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        g = [cells[i][2] - cells[i][1] * p[i] for i in everything]
        h = [cells[i][1] * p[i] * (1 - p[i]) for i in everything]
        top = best(everything, g, h)[1]
        yes = [i for i in everything if side[top][i]]
        no = [i for i in everything if not side[top][i]]
        branches = [best(rows, g, h) for rows in (yes, no)]
        for rows, (_, t, a, b) in zip((yes, no), branches, strict=True):
            for i in rows:
                scores[i] += a if side[t][i] else b
        trees.append((top, *((t, a, b) for _, t, a, b in branches)))
    return trees


def raw_score(trees: list, cell: tuple[int, ...]) -> float:
    out = 0.0
    for top, yes, no in trees:
        t, a, b = yes if _goes(cell, top) else no
        out += a if _goes(cell, t) else b
    return out


def calibrate(trees: list, cells: list[tuple[tuple[int, ...], float, float]]) -> dict[int, float]:
    """Per kind the lowest score at and above which at least PRECISION of the candidates are positive."""
    out = {}
    for kind in range(len(KINDS)):
        ranked = sorted(((raw_score(trees, c), n, p) for c, n, p in cells if c[0] == kind), reverse=True)
        n = pos = 0.0
        for i, (s, cn, cp) in enumerate(ranked):
            n, pos = n + cn, pos + cp
            last = i + 1 == len(ranked) or ranked[i + 1][0] < s
            if last and n >= LEAST and pos >= PRECISION * n:
                out[kind] = s
    return out


def _score_column(trees: list, c: Column) -> Column:
    def goes(t):
        f, v, ordered = t
        x = c[FEATURES[f]]
        return x <= v if ordered else x == v

    out = F.lit(0.0)
    for top, *branches in trees:
        yes, no = (F.when(goes(t), F.lit(a)).otherwise(F.lit(b)) for t, a, b in branches)
        out = out + F.when(goes(top), yes).otherwise(no)
    return out


def truth(spark: SparkSession, n: int = PLANTED) -> DataFrame:
    """third, features, n, p: candidates of the planted lines that no test settles, and how many of them are positive."""
    lines = local_rows(spark, planted(n), "i long, text string, start int, end int, good boolean").repartition(spark.sparkContext.defaultParallelism)
    found = lines.select((F.col("i") % 3).alias("third"), "start", "end", "good", F.explode(F.array(candidates(F.col("text")))).alias("found"))
    open_ = F.filter("found", lambda c: ~(c["valid"] & (c["kind"] < 4)) & ~_inside_valid(c, F.col("found")))
    c = found.select("third", "start", "end", "good", F.explode(open_).alias("c"))
    both = F.least("end", "c.end") - F.greatest("start", "c.start")
    # most of the planted span, and little else
    hit = F.col("good") & (both * 2 > F.col("end") - F.col("start")) & (both * 3 > (F.col("c.end") - F.col("c.start")) * 2)
    return c.select("third", hit.cast("int").alias("hit"), *[F.col(f"c.{f}").alias(f) for f in FEATURES]).groupBy("third", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("p"))


def learned(spark: SparkSession, n: int = PLANTED) -> tuple[list, dict[int, float], list[tuple[tuple[int, ...], float, float]]]:
    """Trees, the kinds' cutoffs, and the cells of the third that saw neither."""
    thirds: dict[int, list] = {0: [], 1: [], 2: []}
    for r in truth(spark, n).collect():  # at most 3 x prod(SIZES) cells
        thirds[r["third"]].append((tuple(r[f] for f in FEATURES), float(r["n"]), float(r["p"])))
    trees = fit(sorted(thirds[0]))
    return trees, calibrate(trees, sorted(thirds[1])), sorted(thirds[2])


def report(spark: SparkSession, n: int = PLANTED) -> dict[str, tuple[float, float]]:
    """Precision and recall of the selected candidates of each kind that has a cutoff, on the lines left for it."""
    trees, cuts, cells = learned(spark, n)
    out = {}
    for kind, cut in cuts.items():
        own = [(raw_score(trees, c) >= cut - 1e-9, n, p) for c, n, p in cells if c[0] == kind]
        chosen, hits, all_ = sum(n for yes, n, _ in own if yes), sum(p for yes, _, p in own if yes), sum(p for _, _, p in own)
        out[KINDS[kind]] = (hits / max(chosen, 1), hits / max(all_, 1))
    return out


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted_lines: int = PLANTED) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end) sorted; kind indexes KINDS. planted_lines bounds the training sample."""
    trees, cuts, _ = learned(docs.sparkSession, planted_lines)
    clean = F.translate(text_or_empty(text_col), OPEN + CLOSE, OTHER + OTHER)
    # generators: what they give is computed once for all its uses
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(F.struct(let(clean, candidates).alias("found")))).alias("x")).select("doc_id", "x.found")
    slim = lambda a: F.transform(a, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    base = slim(F.filter("found", lambda c: c["valid"] & (c["kind"] < 4)))
    added = F.array().cast(CANDIDATES)
    if cuts:
        added = F.filter("found", lambda c: ~(c["valid"] & (c["kind"] < 4)) & _over(trees, cuts, c) & ~_inside_valid(c, F.col("found")))
    out = rows.select("doc_id", F.explode(F.array(F.struct(F.sort_array(base).alias("base"), F.sort_array(F.concat(base, slim(added))).alias("spans")))).alias("x"))
    return out.select("doc_id", "x.base", "x.spans")


def _over(trees: list, cuts: dict[int, float], c: Column) -> Column:
    cut = F.lit(float("inf"))
    for kind, s in cuts.items():
        cut = F.when(c["kind"] == kind, F.lit(s)).otherwise(cut)
    return _score_column(trees, c) >= cut - F.lit(1e-9)


def listed(a: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(a, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in brackets; overlapping spans become one."""
    found = spans(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"))
    joined = docs.join(found.dropDuplicates(["__id"]), F.col(id_col).eqNullSafe(F.col("__id")), "left")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    text = text_or_empty(text_col)

    def step(a: Column, s: Column) -> Column:
        clear = s["start"] >= a["at"]
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.struct(F.when(clear, F.concat(a["out"], gap, F.get(names, s["kind"]))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    new = F.aggregate(F.coalesce("__spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return joined.select(*[new.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
