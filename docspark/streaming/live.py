"""Live queries and subscriptions over a stream of document versions.

A stream frame has one row per write: id, hlc, deleted and the document's columns. A live
query keeps, per id, only the clock it last saw and whether the document matched; the
events are add, change and remove. A subscription fires when a new body matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docspark.functions import topics as topic
from docspark.sources.collection import Collection

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_SCHEMA = "id string, hlc long, event string, row string"


def classify(was: bool, now: bool) -> str | None:
    """add, change or remove, or None for a document outside before and after."""
    if now:
        return "change" if was else "add"
    return "remove" if was else None


class _Matcher(StatefulProcessor):
    """State per id: (hlc, matched). Older versions than the seen one are ignored, so replays change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "hlc long, matched boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.sort_values("hlc").iloc[-1]
        self.seen.update((int(last["hlc"]), bool(last["matched"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("hlc", kind="stable")
        state = self.seen.get() if self.seen.exists() else None
        hlc, matched = (state[0], state[1]) if state else (None, False)
        out = []
        for r in batch.itertuples(index=False):
            if hlc is not None and r.hlc <= hlc:
                continue
            event = classify(bool(matched), bool(r.matched))
            hlc, matched = int(r.hlc), bool(r.matched)
            if event:
                out.append((key[0], hlc, event, None if event == "remove" else r.row))
        if hlc is not None:
            self.seen.update((hlc, matched))
        yield pd.DataFrame(out, columns=["id", "hlc", "event", "row"])

    def close(self) -> None:
        pass


def marked(stream: DataFrame, text: str, params: dict | None = None, id_col: str = "id", body: str | None = None) -> DataFrame:
    """id, hlc, matched, row of every write under a SUBSCRIBE query."""
    c = Collection(stream, id_col, body)
    plan = c.plan(text, params)
    if not plan.subscribe:
        raise ValueError("a live query needs SUBSCRIBE")
    hit = c.matches([list(x) for x in plan.where]) if plan.where else F.lit(True)
    key = F.col(id_col).cast("string")
    if plan.id_prefix is not None:
        hit = hit & key.startswith(plan.id_prefix)
    if plan.id_range is not None:
        low, high = plan.id_range
        hit = hit & (key >= low if low is not None else F.lit(True)) & (key < high if high is not None else F.lit(True))
    base = c.binding()
    columns = [base.value(keys).col.alias(name) for name, _, keys in plan.select] if plan.select is not None else [F.col(f"`{x}`") for x in stream.columns if x not in ("hlc", "deleted")]
    row = F.to_json(F.struct(*columns))
    return stream.select(key.alias("id"), F.col("hlc").cast("long").alias("hlc"), (hit & ~F.coalesce("deleted", F.lit(False))).alias("matched"), row.alias("row"))


def live(stream: DataFrame, text: str, params: dict | None = None, id_col: str = "id", body: str | None = None, start: DataFrame | None = None) -> DataFrame:
    """Streaming add / change / remove events of a SUBSCRIBE query; start: the documents' last versions before the stream, none by default."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = marked(stream, text, params, id_col, body)
    before = marked(start, text, params, id_col, body).select("id", "hlc", "matched").groupBy("id") if start is not None else None
    return rows.groupBy("id").transformWithStateInPandas(_Matcher(), EVENT_SCHEMA, "Append", "None", before)


def subscribe(collection: Collection, stream: DataFrame, text: str, handler: Callable[[DataFrame, int], None], checkpoint: str, params: dict | None = None):
    """Gives the handler the snapshot's rows, then one row `ready`, then the live events batch by batch; returns the running query.

    Rows are (id, hlc, event, row). The collection's frame needs hlc and deleted, as a stream has.
    LIMIT bounds the snapshot only. After a restart, when the checkpoint is there, only live events follow.
    """
    table = collection.df
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        plan = collection.plan(text, params)
        rows = marked(table, text, params, collection.id_col, collection.body).where("matched")
        if plan.limit is not None:
            rows = rows.orderBy("id").limit(plan.limit)
        handler(rows.select("id", "hlc", F.lit("snapshot").alias("event"), "row"), -2)
        handler(spark.createDataFrame([(None, None, "ready", None)], EVENT_SCHEMA), -1)
    return push(live(stream, text, params, collection.id_col, collection.body, table), handler, checkpoint)


def snapshot(table: DataFrame, text: str, params: dict | None = None, id_col: str = "id", body: str | None = None) -> DataFrame:
    """The rows that a live query starts from; LIMIT bounds these only."""
    c = Collection(table, id_col, body)
    plan = c.plan(text, params)
    plan.subscribe = False
    return c.run(plan)


def replay(history: DataFrame, text: str, params: dict | None = None, id_col: str = "id", body: str | None = None) -> DataFrame:
    """The same events from a finished history, by one window per id."""
    from pyspark.sql import Window

    rows = marked(history, text, params, id_col, body)
    w = Window.partitionBy("id").orderBy("hlc")
    was = F.coalesce(F.lag("matched").over(w), F.lit(False))
    event = F.when(F.col("matched") & was, "change").when(F.col("matched"), "add").when(was, "remove")
    return rows.select("id", "hlc", event.alias("event"), F.when(event != "remove", F.col("row")).alias("row")).where("event IS NOT NULL")


def path_subscription(stream: DataFrame, pattern: str, topics_col: str) -> DataFrame:
    """Writes, tombstones included, with a topic that matches."""
    return stream.where(topic.matches(F.col(topics_col), pattern))


def query_subscription(stream: DataFrame, hit: Column, deleted_col: str = "deleted") -> DataFrame:
    """New bodies that match; never tombstones, never departures."""
    return stream.where(~F.coalesce(F.col(deleted_col), F.lit(False)) & F.coalesce(hit, F.lit(False)))


def history_source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """An append-only history folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def push(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "100 milliseconds"):
    """Delivers micro-batches to a handler; a batch is acknowledged by the checkpoint when it returns."""
    return events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def drain(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """As push, over what is there now, then stops: the outbox's fold and ack."""
    return events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outbox_batches(tags: dict[str, Column], deliver: Callable[[str, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A handler that gives, per tag with anything new, one entry for each document: the latest of its writes in the batch that the tag's condition takes."""
    from docspark.operators.changes import latest

    def handle(batch: DataFrame, _: int) -> None:
        for tag, condition in tags.items():
            entries = latest(batch.where(condition))
            if entries.limit(1).count():
                deliver(tag, entries)

    return handle


def index_batches(text_col: str, out_col: str, embed, save: Callable[[DataFrame], None], remove: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A handler that embeds the latest version of each changed document and saves the vectors; remove gets the ids whose latest version is a tombstone."""
    from docspark.operators.changes import latest
    from docspark.operators.search import embed_column

    def handle(batch: DataFrame, _: int) -> None:
        rows, gone = latest(batch), F.coalesce(F.col("deleted"), F.lit(False))
        remove(rows.where(gone).select("id"))
        save(embed_column(rows.where(~gone), text_col, out_col, embed))

    return handle
