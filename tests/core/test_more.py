"""Inverted lists, TurboQuant codes, embedding chains, subscriptions with a snapshot, session state, regex validation, import and export."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.functions import topics, vectors
from docspark.operators import search, sessions
from docspark.operators.ann import InvertedLists
from docspark.operators.quantization import TurboQuantizer
from docspark.plans.errors import QueryError
from docspark.sources.collection import Collection


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((20, 24)) * 3
    data = [(i, (centers[i % 20] + rng.standard_normal(24)).tolist(), i % 3) for i in range(900)]
    return spark.createDataFrame(data, "id long, vector array<double>, label int").cache()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_inverted_lists(spark, clustered, tmp_path, metric):
    index = InvertedLists(spark, str(tmp_path / "i"), metric).build(clustered.where("id < 800"), lists=20, sample=500)
    index.add(clustered.where("id >= 800"))
    exact = search.VectorIndex(clustered, metric=metric)
    found = 0
    for r in clustered.where("id % 90 = 0").collect():
        want = [x["id"] for x in exact.search(r["vector"], 10).collect()]
        assert [x["id"] for x in index.search(r["vector"], 10, probes=20).collect()] == want
        found += len({x["id"] for x in index.search(r["vector"], 10, probes=4).collect()} & set(want))
    assert found >= 0.9 * 100
    plan = index.search([1.0] * 24, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "") or "cell#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert all(x["label"] == 1 for x in index.search([1.0] * 24, 30, where=F.col("label") == 1).collect())


def test_turbo_quantizer(spark, clustered):
    q = TurboQuantizer(24, 4)
    coded = clustered.withColumn("c", q.encode(F.col("vector"))).cache()
    query = clustered.where("id = 5").first()["vector"]
    rows = coded.select("id", "vector", q.dot(F.col("c"), query).alias("near"), q.decode(F.col("c")).alias("back")).collect()
    x = np.array([r["vector"] for r in rows])
    exact, near, back = x @ np.array(query), np.array([r["near"] for r in rows]), np.array([r["back"] for r in rows])
    assert np.corrcoef(exact, near)[0, 1] > 0.99
    assert (np.linalg.norm(back - x, axis=1) / np.linalg.norm(x, axis=1)).mean() < 0.15
    best = lambda s: {rows[i]["id"] for i in np.argsort(-s)[:10]}
    assert len(best(exact) & best(near)) >= 7
    with pytest.raises(ValueError):
        TurboQuantizer(8, 5)


def test_embed_chain(spark):
    asked = []

    def broken(texts):
        raise OSError("down")

    def short(texts):
        return [[0.0]] * (len(texts) - 1)

    def sizes(texts):
        asked.append(len(texts))
        return [[float(len(t))] for t in texts]

    assert search.EmbedChain(broken, short, sizes, batch=2)(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]] and asked == [2, 1]
    with pytest.raises(RuntimeError):
        search.EmbedChain(broken)(["a"])
    df = spark.createDataFrame([("a",), (None,), ("bbbb",)], "t string")
    chain = search.EmbedChain(lambda texts: [[float(len(t))] for t in texts])
    assert sorted(r["v"][0] for r in search.embed_column(df, "t", "v", chain).collect()) == [0.0, 1.0, 4.0]


def test_search_columns(clustered):
    index = search.VectorIndex(clustered.withColumn("text", F.lit("t")))
    v = clustered.first()["vector"]
    assert set(index.search(v, 2).columns) == {"id", "label", "text", "score"}
    assert index.search(v, 2, text_col="text", include_metadata=False).columns == ["id", "text", "score"]
    assert "text" not in index.search(v, 2, text_col="text", include_text=False).columns


def test_overfetch(spark):
    docs = spark.createDataFrame([(str(i), "word " * (10 - i), i) for i in range(9)], "id string, text string, n int")
    index = search.SearchIndex(text=search.BM25(docs))
    query = "SELECT n FROM bm25_top_k('word', k => 2) AS h WHERE h.n >= 4"
    assert Collection.typed(docs, "id", search=index, overfetch=1).query(query).count() == 0
    assert [r["n"] for r in Collection.typed(docs, "id", search=index, overfetch=3).query(query).collect()] == [4, 5]


def test_subscribe_begins_with_a_snapshot(spark, tmp_path):
    schema = "id string, hlc long, deleted boolean, k string"
    table = spark.createDataFrame([("a", 1, False, "y"), ("b", 2, False, "x"), ("c", 3, True, "y")], schema)
    writes = [("a", 4, False, "y"), ("b", 5, False, "y"), ("a", 6, False, "z")]
    spark.createDataFrame(writes, schema).coalesce(1).write.parquet(str(tmp_path / "h"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "h"))
    got = []
    handler = lambda df, n: got.extend((r["id"], r["hlc"], r["event"]) for r in df.orderBy("hlc").collect())
    query = Collection.typed(table, "id").subscribe("SELECT k FROM db WHERE k = 'y' SUBSCRIBE", stream, handler, str(tmp_path / "c"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert got == [("a", 1, "snapshot"), (None, None, "ready"), ("a", 4, "change"), ("b", 5, "add"), ("a", 6, "remove")]


def test_session_state(spark):
    rows = [("s", 1, "x", True, "1"), ("s", 2, "y", True, "2"), ("s", 3, "x", False, None), ("t", 1, "x", True, "9")]
    df = spark.createDataFrame(rows, "session string, ts long, key string, pinned boolean, value string")
    assert [r["key"] for r in sessions.pinned(df, "s").collect()] == ["y"]
    assert {r["key"]: r["value"] for r in sessions.data_map(df, "s").collect()} == {"y": "2"}
    h = spark.createDataFrame([("2", "r", 1, "a"), ("1", "r", 0, "b"), ("3", "q", 0, "a")], "id string, chain_root string, chain_depth int, to string")
    assert [r["id"] for r in sessions.handoffs(h, chain_root="r").collect()] == ["1", "2"]


def test_regex_is_checked_by_the_engine_that_runs_it(spark):
    c = Collection.from_json(spark, [{"id": "1", "s": "q"}])
    for bad in ("(?P<q>a)", "(", "[a"):
        with pytest.raises(QueryError):
            c.find({"where": [["regex", ["s"], bad]]})
    assert c.find({"where": [["regex", ["s"], r"^\p{L}$"]]}).count() == 1
    assert c.find({"where": [["regex", ["s"], "(?<q>q)"]]}).count() == 1


def test_hydrate_and_json_topics(spark):
    hits = spark.createDataFrame([("a", 1.0), ("z", 0.5)], "id string, score double")
    store = spark.createDataFrame([("a", "text", 3)], "key string, text string, n int")
    assert {r["id"]: r["text"] for r in search.hydrate(hits, store, "key", ["text"]).collect()} == {"a": "text", "z": None}
    df = spark.createDataFrame([('{"a":{"b":[1,"x",null]},"_p":1}',), (None,)], "j string")
    assert [r["t"] for r in df.select(topics.json_topics(F.col("j")).alias("t")).collect()] == [["a/b/1", "a/b/null", "a/b/x"], []]


def test_int8_codes(spark):
    r = random.Random(1)
    v = [r.uniform(-2, 2) for _ in range(16)]
    q = spark.createDataFrame([(v,), ([0.0, 0.0],)], "v array<double>").select(vectors.quantize_int8(F.col("v")).alias("q")).collect()
    assert q[0]["q"]["codes"] == [round(x / max(map(abs, v)) * 127) for x in v] and q[1]["q"]["codes"] == [0, 0]
