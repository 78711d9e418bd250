import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docspark.functions import clocks, topics, vectors
from docspark.operators import changes, postings, replication, search, sessions
from docspark.operators.quantization import ProductQuantizer
from docspark.sources.collection import Collection
from docspark.sources.store import Conflict, Database
from docspark.streaming import live


def test_bm25_formula(spark):
    one = search.BM25(spark.createDataFrame([("a", "hello world")], "id string, text string"))
    assert one.search("hello").first()["score"] == pytest.approx(math.log(0.5 / 1.5 + 1), abs=1e-9)
    two = search.BM25(spark.createDataFrame([("a", "Rust rust go"), ("b", "go"), ("c", None), ("d", "éa rust-lang")], "id string, text string"))
    got = {r["id"]: r["score"] for r in two.search("rust RUST zig").collect()}
    idf, avg = math.log((4 - 2 + 0.5) / 2.5 + 1), (3 + 1 + 0 + 3) / 4
    want = lambda tf, n: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    assert got == pytest.approx({"a": want(2, 3), "d": want(1, 3)}, abs=1e-9)
    assert two.search("").count() == 0 and two.search("none").count() == 0
    w = {(r["id"], r["term"]): r["weight"] for r in two.weights().collect()}
    assert w["a", "rust"] == pytest.approx(want(2, 3))
    assert {("a", r["term"]): r["weight"] for r in two.get_vector("a").collect()} == pytest.approx({k: x for k, x in w.items() if k[0] == "a"})
    least = search.BM25(two.docs, min_length=3).stats().first()
    assert (least["n_docs"], least["n_tokens"]) == (4, 4)
    assert {r["term"]: r["weight"] for r in two.encode("rust zig").collect()}.keys() == {"rust", "zig"}


def test_weights_count_tokens_where_the_document_is(spark, monkeypatch):
    monkeypatch.setattr(postings, "RUN", 3)
    monkeypatch.setattr(postings, "HELD", 2)
    texts = ["Rust rust go", "", None, "É 3x-Y_z \u212aelvin İ\x00a", "the the the", "go", "go a rust"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "go go zig"), (None, "nobody s")]
    bm = search.BM25(spark.createDataFrame(rows, "id long, text string"))
    held = [(i, search.tokenize(t or "")) for i, t in rows]
    tf = Counter((i, len(ws), w) for i, ws in held for w in ws)  # as in SQL: rows of one id and length are one vector
    df, n, avg = Counter(w for _, _, w in tf), len(held), sum(len(ws) for _, ws in held) / len(held)
    score = lambda x, size, d: math.log((n - d + 0.5) / (d + 0.5) + 1) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size / avg))
    got = sorted((str(r["id"]), r["term"], round(r["weight"], 9)) for r in bm.weights().collect())
    assert got == sorted((str(i), w, round(score(x, size, df[w]), 9)) for (i, size, w), x in tf.items())
    assert {r["term"]: r["df"] for r in bm.document_frequency().collect()} == Counter(w for _, ws in held for w in set(ws))
    single = search.BM25(spark.createDataFrame(rows[:6], "id long, text string"))
    plan = single.weights()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "SortMergeJoin" not in plan and "split(" not in plan
    wide = search.BM25(single.docs, min_length=3).weights()
    assert {(r["id"], r["term"]) for r in wide.collect()} == {(0, "rust"), (3, "kelvin"), (4, "the")}


def test_term_index_equals_scan(spark, tmp_path):
    r = random.Random(4)
    texts = {str(i): " ".join(r.choice(["rust", "go", "zig", "ada", "c", "É"]) for _ in range(r.randrange(12))) for i in range(40)}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "id string, text string")
    index = search.TermIndex(spark, str(tmp_path / "a"))
    index.add(frame({k: "rust rust" if int(k) < 9 else t for k, t in texts.items()}))
    index.add(frame({k: t for k, t in texts.items() if int(k) < 9}))
    index.remove(["20", "21", "nobody"])
    texts.pop("20"), texts.pop("21")
    one = index.merge(str(tmp_path / "b"))
    for query in ("rust zig rust", "ada", "none"):
        want = {x["id"]: x["score"] for x in search.BM25(frame(texts)).scores(query).collect()}
        for i in (index, one):
            assert {x["id"]: x["score"] for x in i.scores(query).collect()} == pytest.approx(want), query
    assert index.stats().first() == search.BM25(frame(texts)).stats().first() and index.search("").count() == 0
    plan = one._postings(["rust"])._jdf.queryExecution().toString()
    assert "EqualTo(term,rust)" in plan and "PartitionFilters: [isnotnull(f" in plan


def test_term_index_moves_no_postings_but_in_a_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RUN", 7)
    written = []
    write = search.TermIndex._write
    monkeypatch.setattr(search.TermIndex, "_write", lambda self, told, rows: (written.append(rows), write(self, told, rows))[1])
    texts = {"1": "go rust go", "2": "", "3": None, "4": "zig É go", "5": "ada rust"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id string, text string")
    index = search.TermIndex(spark, str(tmp_path / "a"))
    for part in (texts, {"1": "rust", "3": "go 3"}, {"1": "zig zig", "6": "go"}):
        index.add(frame(part))
        texts |= part
        assert "hashpartitioning" not in written[-1]._jdf.queryExecution().executedPlan().toString()
    index.remove(["5", "nobody"])
    texts.pop("5")
    want = {x["id"]: x["score"] for x in search.BM25(frame(texts)).scores("go zig rust 3").collect()}
    for bound in (100, 0):  # later ids broadcast, or joined by a shuffle
        monkeypatch.setattr(search.TermIndex, "MOST_BROADCAST", bound)
        one = index.merge(str(tmp_path / f"b{bound}"))
        assert "hashpartitioning(f" not in written[-1]._jdf.queryExecution().executedPlan().toString()
        for i in (index, one):
            assert {x["id"]: x["score"] for x in i.scores("go zig rust 3").collect()} == pytest.approx(want)
        live = one._postings()
        assert live.count() == len({(k, w) for k, t in texts.items() for w in search.tokenize(t or "")})
        assert {r["f"] for r in live.collect()} == {postings.folder(r["term"].encode()) for r in live.collect()}
        if bound:
            plan = index._postings()._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_tokenizer():
    assert search.tokenize("Été 3x-Y_z") == ["t", "3x", "y", "z"]


def test_fusion(spark):
    t = spark.createDataFrame([("a", 4.0), ("b", 2.0)], "id string, score double")
    v = spark.createDataFrame([("b", 0.9), ("c", 0.5)], "id string, score double")
    rrf = {r["id"]: r["score"] for r in search.hybrid(t, v, 5).collect()}
    assert rrf == pytest.approx({"a": 0.5 / 61 + 0.5 / 1060, "b": 0.5 / 62 + 0.5 / 61, "c": 0.5 / 1060 + 0.5 / 62})
    lin = {r["id"]: r["score"] for r in search.hybrid(t, v, 5, "linear").collect()}
    assert lin == pytest.approx({"a": 0.5, "b": 0.25 + 0.45, "c": 0.25})


def test_table_functions(spark):
    docs = [{"id": f"d{i}", "title": t, "kind": k} for i, (t, k) in enumerate([("rust book", "book"), ("go manual", "manual"), ("rust manual rust", "manual"), ("erlang", "book")], 1)]
    flat = spark.createDataFrame([(d["id"], d["title"]) for d in docs], "id string, title string")
    store = search.embed_column(flat, "title", "vector")
    index = search.SearchIndex(search.BM25(flat, "id", "title"), search.VectorIndex(store))
    c = Collection.from_json(spark, docs, search=index)
    rows = c.query("SELECT _score, _distance FROM vector_top_k('erlang', k => 3) AS v").collect()
    assert rows[0]["id"] == "d4" and rows[0]["_score"] > 0.99 and rows[0]["_distance"] == pytest.approx(1 - rows[0]["_score"])
    assert [r["_score"] for r in rows] == sorted((r["_score"] for r in rows), reverse=True)
    assert [r["id"] for r in c.query("SELECT * FROM bm25_top_k('rust') AS h").collect()] == ["d3", "d1"]
    assert [r["id"] for r in c.query("SELECT * FROM bm25_top_k('rust', k => 1) AS h WHERE h.kind = 'book'").collect()] == ["d1"]
    assert c.query("SELECT _score FROM hybrid_top_k('rust', k => 2) AS h").count() == 2
    again = search.rerank(flat, lambda q, ts: [float(t.count(q)) for t in ts], "rust", "title", 2)
    assert [r["id"] for r in again.collect()] == ["d3", "d1"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    got = df.select(vectors.distance(F.col("a"), F.col("b")).alias("c"), vectors.distance(F.col("a"), F.col("b"), "euclidean").alias("e"), vectors.dequantize_int8(vectors.quantize_int8(F.col("a"))).alias("q")).collect()
    assert [r["c"] for r in got] == pytest.approx([1.0, 1.0, 0.0]) and got[0]["e"] == pytest.approx(5**0.5)
    assert got[2]["q"] == pytest.approx([3.0, 4.0], abs=0.02)
    index = search.VectorIndex(spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "id string, vector array<float>"))
    index = index.upsert(spark.createDataFrame([("y", [1.0, 0.1]), ("z", [0.9, 0.0])], "id string, vector array<float>")).delete(["x"])
    assert [r["id"] for r in index.search([1.0, 0.0], 2).collect()] == ["z", "y"] and index.count() == 2


def test_product_quantizer(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(i % 4, 0.01) for _ in range(8)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    pq = ProductQuantizer(m=2, k=4, iterations=10).fit(df, "v")
    coded = df.select("id", pq.encode(F.col("v")).alias("c")).select("id", pq.decode(F.col("c")).alias("d"), pq.distance(F.col("c"), rows[0][1]).alias("near")).collect()
    assert all(abs(a - b) < 0.2 for (_, v), row in zip(rows, coded, strict=True) for a, b in zip(v, row["d"], strict=True))
    assert {row["id"] % 4 for row in sorted(coded, key=lambda x: x["near"])[:10]} == {0}


def test_clocks(spark):
    vv = lambda **k: F.create_map(*[x for a, h in k.items() for x in (F.lit(a), clocks.clock(F.lit(h), F.lit(0)))])
    a, b, c = vv(x=2, y=1), vv(x=1, y=1), vv(z=5)
    row = spark.range(1).select(
        clocks.compare(a, b).alias("ab"), clocks.compare(b, a).alias("ba"), clocks.compare(a, a).alias("aa"), clocks.compare(a, c).alias("ac"),
        clocks.compare(clocks.merge(a, c), a).alias("m"), clocks.contains(a, F.lit("x"), clocks.clock(F.lit(2), F.lit(0))).alias("in"),
        clocks.token(clocks.clock(F.lit(255), F.lit(1)), F.lit("n1")).alias("t"),
    ).first()
    assert (row["ab"], row["ba"], row["aa"], row["ac"], row["m"], row["in"]) == ("dominates", "dominated", "eq", "concurrent", "dominates", True)
    assert row["t"] == "00000000000000ff00000001@6e31"
    back = spark.range(1).select(clocks.token_clock(F.lit(row["t"])).alias("c"), clocks.token_author(F.lit(row["t"])).alias("a")).first()
    assert back["c"] == (255, 1) and back["a"] == "n1"


@pytest.mark.parametrize(("pattern", "topic", "hit"), [("a/b", "a/b", True), ("a/+", "a/b", True), ("a/+", "a/b/c", False), ("a/#", "a", True), ("a/#", "a/b/c", True), ("a/#", "ab", False), ("#", "x/y", True), ("+/b/#", "a/b/c/d", True), ("+/b/#", "a/c", False)])
def test_patterns(spark, pattern, topic, hit):
    assert spark.range(1).select(topics.matches(F.array(F.lit(topic)), pattern)).first()[0] == hit


def test_topics():
    assert topics.of_json('{"a": {"b": [1, "x"]}, "c": true, "_r": 1}') == ["a/b/1", "a/b/x", "c/true"]


HISTORY = [("a", 1, False, "x"), ("b", 2, False, "y"), ("a", 3, False, "y"), ("c", 4, False, "x"), ("b", 5, True, "y"), ("c", 6, False, "z")]


@pytest.fixture(scope="module")
def history(spark):
    df = spark.createDataFrame(HISTORY, "id string, hlc long, deleted boolean, k string")
    return df.withColumn("topics", topics.of_fields({"k": F.col("k")}))


def test_changes(history):
    seq = lambda df: [r["hlc"] for r in df.collect()]
    assert seq(changes.changes(history)) == [3, 5, 6]
    assert seq(changes.changes(history, since=3)) == [5, 6]
    assert seq(changes.changes(history, limit=2, descending=True)) == [5, 3]
    assert seq(changes.changes(history, paths=["k/x", "k/z"], topics_col="topics")) == [6]
    assert seq(changes.as_of(history, 2)) == [1, 2] or sorted(seq(changes.as_of(history, 2))) == [1, 2]
    assert sorted(seq(changes.as_of(history, 5))) == [3, 4]
    rows, token, more = changes.page(history, 0, 2)
    assert [r["hlc"] for r in rows] == [3, 5] and token == (5, "b") and more
    assert changes.has_since(history, 5) and not changes.has_since(history, 6)
    assert sorted(seq(changes.retain(history, 5))) == [3, 6]
    with pytest.raises(ValueError):
        changes.as_of(history, 1, floor=2)


def test_pages_keep_documents_that_share_a_clock(spark):
    h = spark.createDataFrame([(f"d{i}", 7 + i // 6, False, "x") for i in range(10)], "id string, hlc long, deleted boolean, k string")
    seen, at, more = [], None, True
    while more:
        rows, at, more = changes.page(h, at, 4)
        seen += [r["id"] for r in rows]
    assert seen == [f"d{i}" for i in range(10)] and changes.page(h, at, 4)[0] == []


def test_changes_style_and_docs(history):
    assert [r["id"] for r in changes.changes(history, style="main").collect()] == ["a", "c"]
    assert changes.changes(history, include_docs=False).columns == ["id", "hlc", "deleted"]
    with pytest.raises(ValueError):
        changes.changes(history, style="other")


def test_latest_breaks_ties_by_author(spark):
    h = spark.createDataFrame([("a", 1, "n1", "x"), ("a", 1, "n2", "y"), ("a", 1, "n2", "z"), ("b", 1, "n1", None)], "id string, hlc long, author string, k string")
    for parts in (1, 3):
        assert sorted((r["id"], r["author"], r["k"]) for r in changes.latest(h.repartition(parts)).collect()) == [("a", "n2", "z"), ("b", "n1", None)]


def test_version_status(spark):
    rows = [("d", 1, "a", {}), ("d", 2, "a", {"a": 1}), ("d", 3, "b", {"a": 1}), ("e", 4, "a", {}), ("e", 5, "b", {"a": 4})]
    h = spark.createDataFrame(rows, "id string, hlc long, author string, seen map<string,long>")
    got = {r["hlc"]: r["status"] for r in changes.versions(h, author_col="author", seen_col="seen").collect()}
    assert got == {1: "superseded", 2: "conflict", 3: "current", 4: "superseded", 5: "current"}
    assert changes.version_body(h, "d", 2, "a").count() == 1
    with pytest.raises(ValueError):
        changes.version_body(h, "d", 2, floor=3)


def test_channels_are_checked(history):
    c = changes.Channels(one=["k/x"])
    assert c.feed(history, "one", "topics").count() == 2
    for bad in (lambda: c.feed(history, "two", "topics"), lambda: c.feed(history, "one", "topics", doc_ids=["a"]), lambda: changes.Channels(none=[])):
        with pytest.raises(ValueError):
            bad()


def test_channel(history):
    feed = {r["id"]: (r["hlc"], r["left"]) for r in changes.channel_feed(history, ["k/x"], "topics").collect()}
    assert feed == {"a": (3, True), "c": (6, True)}
    feed = {r["id"]: (r["hlc"], r["left"], r["deleted"]) for r in changes.channel_feed(history, ["k/y"], "topics").collect()}
    assert feed == {"a": (3, False, False), "b": (5, False, True)}
    assert changes.channel_feed(history, ["k/x"], "topics", include_leaves=False).count() == 0


def test_live_stream_equals_replay(spark, history, tmp_path):
    text = "SELECT k FROM db WHERE k = 'y' SUBSCRIBE"
    want = sorted(tuple(r) for r in live.replay(history, text).select("id", "hlc", "event").collect())
    assert want == [("a", 3, "add"), ("b", 2, "add"), ("b", 5, "remove")]
    for i in range(3):
        history.where(F.col("hlc").between(2 * i + 1, 2 * i + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "h"))
    stream = live.history_source(spark, str(tmp_path / "h"), "id string, hlc long, deleted boolean, k string, topics array<string>", 1)
    got = []
    q = live.drain(live.live(stream, text), lambda df, _: got.extend(tuple(r) for r in df.select("id", "hlc", "event").collect()), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sorted(got) == want
    with pytest.raises(ValueError):
        live.live(stream, "SELECT k FROM db")


def test_subscriptions(history):
    hit = Collection.typed(history, "id").matches([["path", ["k"], "y"]])
    assert [r["hlc"] for r in live.query_subscription(history, hit).orderBy("hlc").collect()] == [2, 3]
    assert [r["hlc"] for r in live.path_subscription(history, "k/#", "topics").orderBy("hlc").collect()] == [1, 2, 3, 4, 5, 6]


def test_versions_converge(spark):
    r = random.Random(7)
    rows, heads = [], {}
    for hlc in range(1, 60):
        i, author = f"d{r.randrange(8)}", r.choice("ab")
        seen = dict(heads.get(i, {})) if r.random() < 0.5 else {a: h for a, h in heads.get(i, {}).items() if a == author}
        rows.append({"id": i, "author": author, "hlc": hlc, "deleted": r.random() < 0.2, "body": str(hlc), "vv": seen})
        heads.setdefault(i, {})[author] = hlc
    for i in heads:
        own = [x for x in rows if x["id"] == i]
        first = replication.fold_versions(own)
        for _ in range(5):
            r.shuffle(own)
            again = replication.fold_versions(own + own[:2])
            assert again[0] == first[0] and again[2] == first[2] == heads[i]
    import json

    df = spark.createDataFrame([(x["id"], x["author"], x["hlc"], x["deleted"], x["body"], json.dumps(x["vv"])) for x in rows], "id string, author string, hlc long, deleted boolean, body string, vv string")
    folds = {i: replication.fold_versions([x for x in rows if x["id"] == i]) for i in heads}
    want = {i: (w["body"], len(c)) for i, (w, c, _) in folds.items()}
    assert {x["id"]: (x["body"], x["n_conflicts"]) for x in replication.apply_versions(df.unionByName(df.where("hlc < 9"))).collect()} == want
    merged = {x["id"]: x["body"] for x in replication.apply_versions(df, lambda x, y, _: f"{x}+{y}").collect()}
    assert merged == {i: replication.fold_versions([x for x in rows if x["id"] == i], lambda x, y, _: f"{x}+{y}")[0]["body"] for i in heads}
    source, target = df.where("author = 'a'"), df.where("author = 'b'")
    assert replication.replicate(source, replication.replicate(source, target)).count() == df.count()


def test_merger_and_resolve():
    a = {"id": "d", "author": "a", "hlc": 1, "deleted": False, "body": "1", "vv": {}}
    b = {**a, "author": "b", "hlc": 2, "body": "2"}
    assert replication.fold_versions([a, b])[1] == [a]
    assert replication.fold_versions([a, b], lambda x, y, _: x + y)[0]["body"] == "12"
    assert replication.resolve(b, [a], "a")["vv"] == {"a": 1, "b": 2}


def test_store(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    put = lambda rows, hlc, **k: db.put(spark.createDataFrame(rows, "id string, json string"), "n", hlc, **k)
    assert db.current().count() == 0
    put([("a", '{"x":1}'), ("b", '{"x":2}')], 1)
    put([("a", '{"x":3}')], 2, expected=spark.createDataFrame([("a", 1)], "id string, hlc long"))
    with pytest.raises(Conflict):
        put([("a", '{"x":4}')], 3, expected=spark.createDataFrame([("a", 1)], "id string, hlc long"))
    db.delete(["b"], "n", 4)
    assert [r["id"] for r in db.collection().query("SELECT x FROM db WHERE x = 3").collect()] == ["a"]
    assert db.collection().query("SELECT * FROM db").count() == 1 and db.info().first()["n_writes"] == 4
    db.put_attachment("a", "f", "text/plain", b"hey", 5)
    db.put_attachment("a", "f", "text/plain", b"hello", 6)
    db.put_attachment("a", "g", "text/plain", b"g", 6)
    assert bytes(db.get_attachment("a", "f").first()["data"]) == b"hello" and {r["name"]: r["length"] for r in db.attachments("a").collect()} == {"f": 5, "g": 1}
    db.delete_attachment("a", "f", 7)
    assert db.get_attachment("a", "f").count() == 0 and [r["name"] for r in db.attachments().collect()] == ["g"]
    assert [(r["name"], r["deleted"]) for r in db.attachment_feed(6).collect()] == [("f", True)]


def test_store_results_per_document(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    docs = lambda *rows: spark.createDataFrame(rows, "id string, json string")
    db.put(docs(("a", '{"x":1}'), ("b", '{"x":2}')), "n", 1)
    seen = spark.createDataFrame([("a", 1), ("b", 0)], "id string, hlc long")
    out = db.put(docs(("a", '{"x":5}'), ("b", '{"x":6}'), ("c", '{"x":7}'), ("c", '{"x":8}')), "n", 2, seen, partial=True)
    assert sorted((r["id"], r["ok"], r["error"]) for r in out.collect()) == [("a", True, None), ("b", False, "conflict"), ("c", False, "duplicate"), ("c", True, None)]
    assert {r["id"]: r["hlc"] for r in db.current_rows().collect()} == {"a": 2, "b": 1, "c": 2}
    assert [r["id"] for r in db.fold_docs("b").collect()] == ["b"] and db.get(["a", "z"]).count() == 1


def test_store_compacts_branches_and_replicates(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    put = lambda d, i, x, hlc, who="n": d.put(spark.createDataFrame([(i, f'{{"x":{x}}}')], "id string, json string"), who, hlc)
    state = lambda d: {r["id"]: r["json"] for r in d.current_rows().where(~F.col("deleted")).collect()}
    for hlc, i in enumerate("abca", 1):
        put(db, i, hlc, hlc)
    before = state(db)
    db.compact()
    assert state(db) == before == {"a": '{"x":4}', "b": '{"x":2}', "c": '{"x":3}'}
    put(db, "b", 9, 5)
    assert state(db)["b"] == '{"x":9}' and {r["id"]: r["hlc"] for r in db.as_of(3).collect()} == {"a": 1, "b": 2, "c": 3}
    fork = db.branch(str(tmp_path / "fork"), 3)
    assert state(fork) == {"a": '{"x":1}', "b": '{"x":2}', "c": '{"x":3}'}
    put(fork, "c", 50, 6, "f")
    assert state(db)["c"] == '{"x":3}'
    db.merge(fork)
    assert state(db)["c"] == '{"x":50}'
    other = Database(spark, str(tmp_path / "other"))
    assert db.replicate_to(other, batch=2) == 6 and state(other) == state(db) and db.replicate_to(other) == 0
    put(db, "d", 1, 8)
    assert db.replicate_to(other) == 1 and state(other) == state(db)
    db.retain(5)
    assert state(db) == state(other) and db.floor() == 5 and db.history().count() == 4
    with pytest.raises(ValueError):
        db.as_of(2)
    with pytest.raises(ValueError):
        db.merge(other)


def test_sessions(spark):
    m = spark.createDataFrame([("s", 3, "c"), ("s", 1, "a"), ("s", 2, "b"), ("t", 1, "z")], "session string, ts long, text string")
    assert [r["text"] for r in sessions.messages(m, "s", since=1, before=3).collect()] == ["a", "b"]
    assert [r["text"] for r in sessions.messages(m, "s", order="desc", limit=1).collect()] == ["c"]
    s = spark.createDataFrame([("s", "x", 0), ("t", "y", 5_000_000)], "id string, agent string, touched long")
    assert [r["id"] for r in sessions.live_sessions(s, 4_000_000).collect()] == ["t"]


def test_index_batches_removes_the_deleted(spark):
    rows = [("a", 1, False, "x"), ("a", 2, True, None), ("b", 1, True, None), ("b", 2, None, "y"), ("c", 1, False, "z")]
    saved, removed = [], []
    handle = live.index_batches("text", "v", lambda t: [float(len(t))], lambda df: saved.extend(df.collect()), lambda df: removed.extend(df.collect()))
    handle(spark.createDataFrame(rows, "id string, hlc long, deleted boolean, text string"), 0)
    assert sorted((r["id"], r["v"]) for r in saved) == [("b", [1.0]), ("c", [1.0])] and [r["id"] for r in removed] == ["a"]
