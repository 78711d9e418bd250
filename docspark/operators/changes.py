"""Changes feed, history, channels and point-in-time views over an append-only history.

A history frame has one row per write: id, hlc (any orderable clock), deleted, and the
body's columns. Nothing here needs more than one keep-latest pass per query. Several
documents may share a clock: feeds are ordered by (hlc, id), and a paging token is that pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import topics as topic


def _ties(history: DataFrame, id_col: str, hlc_col: str) -> list[Column]:
    """What decides between writes of one id with equal clocks: the author, then every other plain column."""
    plain = [f.name for f in history.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType) and f.name not in (id_col, hlc_col)]
    return [F.desc(f"`{c}`") for c in sorted(plain, key=lambda c: (c != "author", c))]


def latest(history: DataFrame, id_col: str = "id", hlc_col: str = "hlc") -> DataFrame:
    """The last write of each id. The rank limit leaves one row per id of each task before the shuffle."""
    w = Window.partitionBy(f"`{id_col}`").orderBy(F.desc(f"`{hlc_col}`"), *_ties(history, id_col, hlc_col))
    return history.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def after(since, id_col: str = "id", hlc_col: str = "hlc") -> Column:
    """Rows past a clock, or past a (clock, id) token."""
    if isinstance(since, tuple):
        clock, id_ = since
        return (F.col(hlc_col) > clock) | ((F.col(hlc_col) == clock) & (F.col(id_col) > id_))
    return F.col(hlc_col) > since


def changes(
    history: DataFrame,
    since=None,
    limit: int | None = None,
    descending: bool = False,
    doc_ids: list | None = None,
    paths: list[str] | None = None,
    matching: Column | None = None,
    topics_col: str | None = None,
    id_col: str = "id",
    hlc_col: str = "hlc",
    deleted_col: str = "deleted",
    style: str = "all",
    include_docs: bool = True,
    body: list[str] | None = None,
) -> DataFrame:
    """One row per document at its latest write, oldest first; since, a clock or a (clock, id) token, is exclusive.

    descending reverses what limit kept. paths are topics or patterns over topics_col; several
    are a union without duplicates, as a document is one row. style main leaves tombstones out,
    as a reader of current documents wants; all keeps them. Without include_docs the body's
    columns are left out: those given, or all but id, clock, author and tombstone mark.
    """
    if style not in ("all", "main"):
        raise ValueError(f"unknown style {style!r}")
    df = history
    if doc_ids is not None:
        df = df.where(F.col(id_col).isin(doc_ids))
    df = latest(df, id_col, hlc_col)
    if since is not None:
        df = df.where(after(since, id_col, hlc_col))
    if style == "main":
        df = df.where(F.col(deleted_col).isNull() | ~F.col(deleted_col))
    if paths is not None:
        hit = F.lit(False)
        for p in paths:
            hit = hit | topic.matches(F.col(topics_col), p)
        df = df.where(hit)
    if matching is not None:
        df = df.where(matching)
    if not include_docs:
        df = df.drop(*(body if body is not None else [c for c in df.columns if c not in (id_col, hlc_col, deleted_col, "author")]))
    df = df.orderBy(hlc_col, id_col)
    if limit is not None:
        df = df.limit(limit)
    return df.orderBy(F.desc(hlc_col), F.desc(id_col)) if descending else df


def count_since(history: DataFrame, since, id_col: str = "id", hlc_col: str = "hlc") -> DataFrame:
    return latest(history, id_col, hlc_col).where(F.col(hlc_col) > since).agg(F.count(F.lit(1)).alias("n"))


def has_since(history: DataFrame, since, hlc_col: str = "hlc") -> bool:
    return bool(history.where(F.col(hlc_col) > since).limit(1).count())


def page(history: DataFrame, since, size: int, **options) -> tuple[list, object, bool]:
    """Rows of one page, the next since, and whether more follow: size + 1 rows are probed.

    The next since is the last row's (clock, id), so documents that share a clock are all given.
    """
    id_col, hlc_col = options.get("id_col", "id"), options.get("hlc_col", "hlc")
    rows = changes(history, since=since, limit=size + 1, **options).collect()  # at most size + 1 rows
    last = rows[min(len(rows), size) - 1] if rows else None
    return rows[:size], (last[hlc_col], last[id_col]) if last else since, len(rows) > size


def history_range(history: DataFrame, low=None, high=None, limit: int | None = None, hlc_col: str = "hlc") -> DataFrame:
    """Every write from low to high, both inclusive."""
    df = history
    if low is not None:
        df = df.where(F.col(hlc_col) >= low)
    if high is not None:
        df = df.where(F.col(hlc_col) <= high)
    df = df.orderBy(hlc_col)
    return df if limit is None else df.limit(limit)


def versions(history: DataFrame, id_col: str = "id", hlc_col: str = "hlc", author_col: str | None = None, seen_col: str | None = None) -> DataFrame:
    """History with status current, conflict or superseded.

    Without author_col the latest write is current and the others are superseded. With it, and
    seen_col, MAP<author, clock> of what each writer had seen, a write that no later write of
    the document has seen, nor its own author overwritten, is a conflict: a sibling of the current one.
    """
    w = Window.partitionBy(f"`{id_col}`").orderBy(F.desc(f"`{hlc_col}`"), *_ties(history, id_col, hlc_col))
    current = F.row_number().over(w) == 1
    if author_col is None:
        return history.withColumn("status", F.when(current, "current").otherwise("superseded"))
    # per document: the largest clock of each author that any writer had seen or written
    own = history.groupBy(F.col(id_col).alias("__id"), F.col(author_col).alias("__author")).agg(F.max(hlc_col).alias("__own"))
    df = history.withColumn("__current", current)
    df = df.join(own, (F.col(id_col) == F.col("__id")) & (F.col(author_col) == F.col("__author")), "left").drop("__id", "__author")
    gone = F.col(hlc_col) < F.col("__own")
    if seen_col is not None:
        seen = history.select(F.col(id_col).alias("__id"), F.explode(seen_col).alias("__author", "__clock")).groupBy("__id", "__author").agg(F.max("__clock").alias("__seen"))
        df = df.join(seen, (F.col(id_col) == F.col("__id")) & (F.col(author_col) == F.col("__author")), "left").drop("__id", "__author")
        gone = gone | F.coalesce(F.col(hlc_col) <= F.col("__seen"), F.lit(False))
        df = df.withColumn("status", F.when(F.col("__current"), "current").when(gone, "superseded").otherwise("conflict")).drop("__seen")
    else:
        df = df.withColumn("status", F.when(F.col("__current"), "current").when(gone, "superseded").otherwise("conflict"))
    return df.drop("__current", "__own")


def version_body(history: DataFrame, id_: object, hlc: object, author: str | None = None, id_col: str = "id", hlc_col: str = "hlc", floor=None) -> DataFrame:
    """One stored version; an error below the retained history's floor."""
    if floor is not None and hlc < floor:
        raise ValueError("the version is before the retained history")
    hit = (F.col(id_col) == id_) & (F.col(hlc_col) == hlc)
    return history.where(hit if author is None else hit & (F.col("author") == author))


def as_of(history: DataFrame, moment, id_col: str = "id", hlc_col: str = "hlc", deleted_col: str = "deleted", floor=None) -> DataFrame:
    """The state at a moment: latest write at or before it, without tombstones."""
    if floor is not None and moment < floor:
        raise ValueError("the moment is before the retained history")
    return latest(history.where(F.col(hlc_col) <= moment), id_col, hlc_col).where(F.col(deleted_col).isNull() | ~F.col(deleted_col))


class Channels:
    """Named channels, each a list of patterns over topics."""

    def __init__(self, **patterns: list[str]):
        for name, ps in patterns.items():
            if not ps or not all(isinstance(p, str) and p for p in ps):
                raise ValueError(f"channel {name!r} needs patterns")
        self.patterns = patterns

    def feed(self, history: DataFrame, name: str, topics_col: str, **options) -> DataFrame:
        """The feed of a channel; it takes no other filter, as leaves would be lost by one."""
        if name not in self.patterns:
            raise ValueError(f"unknown channel {name!r}")
        if clash := {"doc_ids", "paths", "matching"} & set(options):
            raise ValueError(f"a channel feed cannot be combined with {sorted(clash)}")
        return channel_feed(history, self.patterns[name], topics_col, **options)


def channel_feed(history: DataFrame, patterns: list[str], topics_col: str, id_col: str = "id", hlc_col: str = "hlc", deleted_col: str = "deleted", include_leaves: bool = True) -> DataFrame:
    """Latest row per document of a channel: members, tombstones of members, and leave rows on departure."""
    member = F.lit(False)
    for p in patterns:
        member = member | F.coalesce(topic.matches(F.col(topics_col), p), F.lit(False))
    w = Window.partitionBy(id_col).orderBy(hlc_col)
    dead = F.coalesce(F.col(deleted_col), F.lit(False))
    df = history.withColumn("__in", member & ~dead).withColumn("__was", F.coalesce(F.lag("__in").over(w), F.lit(False)))
    df = df.withColumn("left", ~F.col("__in") & F.col("__was") & ~dead)
    kept = df.where(F.col("__in") | F.col("__was"))
    if not include_leaves:
        kept = latest(df.where(F.col("__in") | F.col("__was")), id_col, hlc_col).where(~F.col("left"))
    else:
        kept = latest(kept, id_col, hlc_col)
    return kept.drop("__in", "__was").orderBy(hlc_col, id_col)


def expire(history: DataFrame, now, expires_col: str, id_col: str = "id", hlc_col: str = "hlc", deleted_col: str = "deleted") -> DataFrame:
    """Tombstones for documents whose latest write has expired; a later write that moved the expiry is respected."""
    live = latest(history, id_col, hlc_col).where(~F.coalesce(deleted_col, F.lit(False)))
    return live.where((F.col(expires_col) > 0) & (F.col(expires_col) <= now)).withColumn(deleted_col, F.lit(True))


def retain(history: DataFrame, cutoff, id_col: str = "id", hlc_col: str = "hlc", deleted_col: str = "deleted") -> DataFrame:
    """History after a retention sweep: superseded writes and tombstones at or before the cutoff go."""
    last = F.max(hlc_col).over(Window.partitionBy(id_col))
    df = history.withColumn("__last", F.col(hlc_col) == last)
    old = F.col(hlc_col) <= cutoff
    return df.where(~old | (F.col("__last") & ~F.coalesce(deleted_col, F.lit(False)))).drop("__last")
