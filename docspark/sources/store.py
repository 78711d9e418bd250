"""A database folder: an append-only history of document writes, and of attachments, as Parquet.

    history/e=<epoch>/   writes, appended; a write is never changed
    current/e=<epoch>/   the last write of every document up to that epoch, made by compact()
    attachments/         attachment writes, deletions among them
    _epoch, _parent      small text files: the epoch writes go to; a branch's parent and fork

current() is the last compaction with the epochs after it, so point reads and queries don't
aggregate the whole history. A branch is a folder that names its parent and the fork's clock:
no data is copied. Appends of several writers are all kept; a compare-and-set write checks
before it appends, so writers of the same document need a lock around it. compact() is run
while nobody writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import changes as feed
from docspark.operators.changes import latest
from docspark.operators.replication import Replicator, latest_attachments, missing
from docspark.sources.collection import Collection

HISTORY = "id string, hlc long, author string, deleted boolean, expires_at long, json string"
ATTACHMENTS = "id string, name string, hlc long, author string, deleted boolean, content_type string, length long, digest string, data binary"
RESULTS = "id string, hlc long, ok boolean, error string"


class Conflict(ValueError):
    """A write whose expected revision is not the current one."""


class Database:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _note(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _set_note(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _read(self, folder: str, schema: str) -> DataFrame:
        if not self._fs.exists(self._path(folder)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def _epoch(self) -> int:
        return int(self._note("_epoch") or 0)

    def _parent(self) -> tuple[Database, int] | None:
        note = self._note("_parent")
        if note is None:
            return None
        told = json.loads(note)
        return Database(self.spark, told["path"]), told["fork"]

    # reading

    def history(self) -> DataFrame:
        """Every write, as appended; a branch's begins with its parent's up to the fork."""
        own = self._read("history", f"{HISTORY}, e int").drop("e")
        if (up := self._parent()) is None:
            return own
        parent, fork = up
        return parent.history().where(F.col("hlc") <= fork).unionByName(own)

    def current_rows(self) -> DataFrame:
        """The last write of every document, tombstones included."""
        return latest(self._sources())

    def current(self) -> DataFrame:
        return self.current_rows().select("id", F.parse_json("json").alias("body"), "hlc", "author", "deleted", "expires_at", "json")

    def collection(self, eventual: bool = False, **options) -> Collection:
        """The documents; eventual reads the last compaction alone, which later writes are missing from."""
        rows = self._read(f"current/e={self._epoch()}", HISTORY) if eventual and self._epoch() else self.current_rows()
        return Collection.documents(rows.select("id", F.parse_json("json").alias("body"), "deleted", "expires_at"), **options)

    def get(self, ids: list[str], include_deleted: bool = False) -> DataFrame:
        """The last writes of some documents: the id filter reaches the files before anything is aggregated."""
        wanted = F.col("id").isin(ids)
        rows = latest(self._sources().where(wanted))
        return rows if include_deleted else rows.where(~F.col("deleted"))

    def _sources(self) -> DataFrame:
        epoch = self._epoch()
        if not epoch:
            return self.history()
        return self._read(f"current/e={epoch}", HISTORY).unionByName(self._read("history", f"{HISTORY}, e int").where(F.col("e") >= epoch).drop("e"))

    def fold_docs(self, id_prefix: str = "", include_deleted: bool = False) -> DataFrame:
        """The last writes of documents whose id begins with a prefix, in id order."""
        rows = latest(self._sources().where(F.col("id").startswith(id_prefix)) if id_prefix else self._sources())
        return (rows if include_deleted else rows.where(~F.col("deleted"))).orderBy("id")

    def changes(self, **options) -> DataFrame:
        return feed.changes(self._sources(), **options)

    def page(self, since, size: int, **options) -> tuple[list, object, bool]:
        return feed.page(self._sources(), since, size, **options)

    def as_of(self, moment: int) -> DataFrame:
        return feed.as_of(self.history(), moment, floor=self.floor())

    def versions(self, id_: str) -> DataFrame:
        return feed.versions(self.history().where(F.col("id") == id_))

    def version_body(self, id_: str, hlc: int, author: str | None = None) -> DataFrame:
        return feed.version_body(self.history(), id_, hlc, author, floor=self.floor())

    def floor(self) -> int | None:
        """The oldest clock whose state can still be read; None for all."""
        note = self._note("_floor")
        return None if note is None else int(note)

    # writing

    def _append(self, rows: DataFrame) -> None:
        names = [c.split()[0] for c in HISTORY.split(", ")]
        rows.select(*names).write.mode("append").parquet(f"{self.path}/history/e={self._epoch()}")

    def put(self, docs: DataFrame, author: str, hlc: int, expected: DataFrame | None = None, partial: bool = False) -> DataFrame | None:
        """Appends one version per row of docs (id, json, optional expires_at, deleted) under one clock.

        expected: (id, hlc) the writer saw, null for a document that should not exist. A document
        whose latest clock differs fails the whole batch, or with partial only itself. An id that
        docs hold twice fails, too, beyond the first by its json. With partial the outcome of each
        row comes back as (id, hlc, ok, error).
        """
        cols = docs.columns
        row = docs.select(
            "id",
            F.lit(hlc).cast("long").alias("hlc"),
            F.lit(author).alias("author"),
            (F.coalesce("deleted", F.lit(False)) if "deleted" in cols else F.lit(False)).alias("deleted"),
            (F.coalesce("expires_at", F.lit(0)) if "expires_at" in cols else F.lit(0)).cast("long").alias("expires_at"),
            "json",
        )
        if expected is None and not partial:
            self._append(row)
            return None
        judged = self._judged(row, expected)
        if not partial:
            if judged.where("error IS NOT NULL").limit(1).count():
                raise Conflict("a document has changed since it was read")
            self._append(row)
            return None
        folder = f"{self.path}/results/{uuid.uuid4().hex}"
        judged.write.parquet(folder)  # settled before the append, which would change it
        judged = self.spark.read.schema(f"{HISTORY}, error string").parquet(folder)
        self._append(judged.where("error IS NULL"))
        return judged.select("id", "hlc", F.col("error").isNull().alias("ok"), "error")

    def _judged(self, row: DataFrame, expected: DataFrame | None) -> DataFrame:
        error: Column = F.when(F.col("__nth") > 1, "duplicate")
        w = feed.Window.partitionBy("id").orderBy("json")
        out = row.withColumn("__nth", F.row_number().over(w))
        if expected is not None:
            now = latest(self._sources()).select("id", F.col("hlc").alias("__now"))
            seen = expected.select("id", F.col("hlc").alias("__seen")).dropDuplicates(["id"])
            out = out.join(seen, "id", "left").join(now, "id", "left")
            error = error.when(~F.col("__seen").eqNullSafe(F.col("__now")), "conflict")
        return out.select(*row.columns, error.alias("error"))

    def delete(self, ids: list[str], author: str, hlc: int) -> None:
        gone = self.spark.createDataFrame([(i, None, True) for i in ids], "id string, json string, deleted boolean")
        self.put(gone, author, hlc)

    def receive(self, versions: DataFrame) -> None:
        """Appends replicated versions under their own clocks and authors."""
        self._append(versions)

    # upkeep

    def compact(self) -> None:
        """Writes the last version of every document, which later reads begin with."""
        done = self._epoch()
        self.current_rows().write.mode("overwrite").parquet(f"{self.path}/current/e={done + 1}")
        self._set_note("_epoch", str(done + 1))

    def retain(self, cutoff: int) -> None:
        """Drops superseded writes and tombstones at or before the cutoff, and raises the floor.

        What is kept is written first and then takes the history's place; until the epoch is reset, reads go on from the last compaction.
        """
        done, new, old = self._epoch(), f"history_{uuid.uuid4().hex}", f"old_{uuid.uuid4().hex}"
        feed.retain(self.history(), cutoff).write.parquet(f"{self.path}/{new}/e=0")
        if self._fs.exists(self._path("history")):
            self._fs.rename(self._path("history"), self._path(old))
        self._fs.rename(self._path(new), self._path("history"))
        self._set_note("_epoch", "0")
        self._fs.delete(self._path("_parent"), False)
        self._set_note("_floor", str(max(cutoff, self.floor() or cutoff)))
        self._fs.delete(self._path(f"current/e={done}"), True)
        self._fs.delete(self._path(old), True)

    # branches and replication

    def branch(self, path: str, at: int | None = None) -> Database:
        """A database that begins as this one stood at a clock (now by default) and goes its own way."""
        if at is None:
            at = self.history().agg(F.max("hlc")).first()[0] or 0
        elif (low := self.floor()) is not None and at < low:
            raise ValueError("the moment is before the retained history")
        out = Database(self.spark, path)
        out._set_note("_parent", json.dumps({"path": self.path, "fork": at}))
        return out

    def merge(self, branch: Database) -> None:
        """Takes over what a branch wrote after its fork."""
        up = branch._parent()
        if up is None or up[0].path != self.path:
            raise ValueError("not a branch of this database")
        rows = branch.history().where(F.col("hlc") > up[1])
        self.receive(missing(rows, self.history()))

    def replicate_to(self, target: Database, batch: int = 100_000, matching: Column | None = None) -> int:
        """Sends what the target lacks, from the checkpoint kept there; how many versions were looked at."""
        name = f"_rep_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        load = lambda: None if (n := target._note(name)) is None else tuple(json.loads(n))
        return Replicator(self.history, target.history, target.receive, load, lambda at: target._set_note(name, json.dumps(at)), batch, matching).run()

    # attachments

    def put_attachment(self, id_: str, name: str, content_type: str, data: bytes, hlc: int, author: str = "") -> None:
        row = self.spark.createDataFrame([(id_, name, hlc, author, content_type, bytearray(data))], "id string, name string, hlc long, author string, content_type string, data binary")
        row = row.withColumn("deleted", F.lit(False)).withColumn("length", F.length("data").cast("long")).withColumn("digest", F.sha2("data", 256))
        row.select(*[c.split()[0] for c in ATTACHMENTS.split(", ")]).write.mode("append").parquet(f"{self.path}/attachments")

    def delete_attachment(self, id_: str, name: str, hlc: int, author: str = "") -> None:
        self.spark.createDataFrame([(id_, name, hlc, author, True, None, None, None, None)], ATTACHMENTS).write.mode("append").parquet(f"{self.path}/attachments")

    def attachment_feed(self, since: int | None = None) -> DataFrame:
        """The last write of each attachment, deletions included, oldest first; the blobs' column is not read."""
        rows = latest_attachments(self._read("attachments", ATTACHMENTS).drop("data"))
        return (rows if since is None else rows.where(F.col("hlc") > since)).orderBy("hlc", "id", "name")

    def attachments(self, id_: str | None = None) -> DataFrame:
        """Metadata of the attachments there are."""
        rows = self._read("attachments", ATTACHMENTS).drop("data")
        rows = latest_attachments(rows if id_ is None else rows.where(F.col("id") == id_))
        return rows.where(~F.col("deleted")).select("id", "name", "content_type", "length", "digest", "hlc")

    def get_attachment(self, id_: str, name: str) -> DataFrame:
        """The last content put under a name, or no row."""
        rows = latest_attachments(self._read("attachments", ATTACHMENTS).where((F.col("id") == id_) & (F.col("name") == name)))
        return rows.where(~F.col("deleted")).select("data", "content_type")

    def drop(self) -> None:
        """Deletes the folder. Branches of it lose what they share."""
        self._fs.delete(self._path(""), True)

    def info(self) -> DataFrame:
        rows = self.history()
        return rows.agg(F.count(F.lit(1)).alias("n_writes"), F.count_distinct("id").alias("n_ids"), F.max("hlc").alias("last_hlc"))
