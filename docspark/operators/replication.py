"""Replication: what a target lacks, applying versions, conflicts, branches and attachments.

A version is (id, author, hlc); a document's version vector maps authors to clocks. A
version covered by the target's vector is skipped. Otherwise it dominates the current one
and replaces it, or both are concurrent: the later (hlc, author) wins and the other is
kept as a conflict, unless a merger makes a new body of the two.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators import changes
from docspark.operators.changes import latest


def vectors(versions: DataFrame) -> DataFrame:
    """id, vv: per document the largest clock of each author."""
    heads = versions.groupBy("id", "author").agg(F.max("hlc").alias("hlc"))
    return heads.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("author", "hlc"))).alias("vv"))


def missing(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source versions that the target's vectors don't cover: an anti join on (id, author) heads."""
    heads = target.groupBy("id", "author").agg(F.max("hlc").alias("__have"))
    joined = source.join(heads, ["id", "author"], "left")
    return joined.where(F.col("__have").isNull() | (F.col("hlc") > F.col("__have"))).drop("__have")


def _covers(vv: dict, author: str, hlc) -> bool:
    return author in vv and vv[author] >= hlc


def fold_versions(rows: list[dict], merger: Callable | None = None) -> tuple[dict, list[dict], dict]:
    """The winner, the conflicts and the vector after applying one document's versions, sorted by (hlc, author)."""
    current, conflicts, vv = None, [], {}
    for r in sorted(rows, key=lambda r: (r["hlc"], r["author"])):
        if _covers(vv, r["author"], r["hlc"]):
            continue
        seen = r.get("vv") or {}
        if current is None or _covers(seen, current["author"], current["hlc"]):
            current = r
            conflicts = [c for c in conflicts if not _covers(seen, c["author"], c["hlc"])]
        elif merger is not None:
            current = {**r, "body": merger(current["body"], r["body"], r["id"])}
        else:
            conflicts = [c for c in conflicts if not _covers(seen, c["author"], c["hlc"])] + [current]
            current = r
        for a, h in {**seen, r["author"]: r["hlc"]}.items():
            vv[a] = max(vv.get(a, h), h)
    return current, conflicts, vv


def apply_versions(versions: DataFrame, merger: Callable | None = None) -> DataFrame:
    """id, author, hlc, deleted, body, n_conflicts of each document's winner.

    versions: id, author, hlc (string or long), deleted, body, vv (JSON text of author -> hlc seen by
    the writer, their own last write included). Versions that repeat count once. Only a merger needs
    a document's versions in one task; then history should be swept first.
    """
    kind = versions.schema["hlc"].dataType.simpleString()
    slim = versions.select("id", "author", "hlc", "deleted", "body", "vv")
    if merger is None:
        seen = slim.dropDuplicates(["id", "author", "hlc"]).withColumn("__vv", F.from_json("vv", f"map<string,{kind}>")).drop("vv")
        heads = changes.versions(seen, author_col="author", seen_col="__vv").where("status <> 'superseded'").drop("__vv")
        others = heads.groupBy(F.col("id").alias("__id")).agg(F.sum((F.col("status") == "conflict").cast("long")).alias("n_conflicts"))
        won = heads.where("status = 'current'").select("id", "author", "hlc", F.coalesce("deleted", F.lit(False)).alias("deleted"), "body")
        return won.join(others, F.col("id") == F.col("__id")).drop("__id")
    import json

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        for r in rows:
            r["vv"] = json.loads(r["vv"]) if isinstance(r.get("vv"), str) else {}
        w, conflicts, _ = fold_versions(rows, merger)
        return pd.DataFrame([[w["id"], w["author"], w["hlc"], bool(w["deleted"]), w["body"], len(conflicts)]], columns=["id", "author", "hlc", "deleted", "body", "n_conflicts"])

    return slim.groupBy("id").applyInPandas(run, f"id string, author string, hlc {kind}, deleted boolean, body string, n_conflicts long")


def last_write_wins(versions: DataFrame) -> DataFrame:
    """The winner per id when writers saw nothing of each other: (hlc, author) decides, no Python."""
    return latest(versions)


def resolve(current: dict, conflicts: list[dict], choose: str | None = None, body: object = None) -> dict:
    """Settles a conflict by a chosen author's version or a merged body; its vector covers all siblings."""
    siblings = [current, *conflicts]
    base = next((s for s in siblings if s["author"] == choose), None) if choose else {**current, "body": body}
    if base is None:
        raise ValueError(f"no version of {choose!r}")
    return {**base, "vv": {s["author"]: s["hlc"] for s in siblings}}


def replicate(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target's versions after one exchange."""
    return target.unionByName(missing(source, target))


def branch(history: DataFrame, at=None, hlc_col: str = "hlc") -> DataFrame:
    """History of a branch made at a moment; immutable files make it a reference, not a copy."""
    return history if at is None else history.where(F.col(hlc_col) <= at)


def merge_branch(parent: DataFrame, branch_history: DataFrame, fork) -> DataFrame:
    """The parent's versions with those the branch wrote after the fork."""
    return replicate(branch_history.where(F.col("hlc") > fork), parent)


def attachment_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Attachments (id, name, digest, ..) whose digest the target lacks."""
    return source.join(target.select("id", "name", "digest"), ["id", "name", "digest"], "left_anti")


def latest_attachments(feed: DataFrame) -> DataFrame:
    """Last writer wins per (id, name)."""
    w = Window.partitionBy("id", "name").orderBy(F.desc("hlc"), *[F.desc(c) for c in sorted(set(feed.columns) & {"author", "digest"})])
    return feed.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


class Replicator:
    """A replication that goes on from its checkpoint: versions past the last (hlc, id, author), a batch at a time.

    read gives the source's versions, target the target's, write appends; load and store keep the checkpoint.
    """

    def __init__(self, read: Callable[[], DataFrame], target: Callable[[], DataFrame], write: Callable[[DataFrame], None], load: Callable[[], tuple | None], store: Callable[[tuple], None], batch: int = 100_000, matching: Column | None = None):
        self.read, self.target, self.write, self.load, self.store = read, target, write, load, store
        self.batch, self.matching = batch, matching

    def step(self) -> int:
        """Moves one batch; how many versions it looked at, 0 when the source holds nothing new."""
        at, key = self.load(), ["hlc", "id", "author"]
        source = self.read()
        if at is not None:
            clock, id_, author = at
            later = (F.col("id") > id_) | ((F.col("id") == id_) & (F.col("author") > author))
            source = source.where((F.col("hlc") > clock) | ((F.col("hlc") == clock) & later))
        chunk = source.orderBy(*key).limit(self.batch)
        seen, last = chunk.agg(F.count(F.lit(1)), F.max(F.struct(*key))).first()
        if not seen:
            return 0
        wanted = chunk if self.matching is None else chunk.where(self.matching)
        self.write(missing(wanted, self.target()))
        self.store(tuple(last))
        return seen

    def run(self) -> int:
        """Steps until the source is drained; versions written twice by a restart are covered and skipped."""
        total = 0
        while n := self.step():
            total += n
        return total
