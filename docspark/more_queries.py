"""Further registered queries: stores, files, streams, vectors and the language's edges, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import clocks, documents, topics
from docspark.operators import changes, search, sessions
from docspark.operators.quantization import ProductQuantizer, TurboQuantizer
from docspark.plans import conditions
from docspark.plans.compiler import compile_query
from docspark.plans.errors import QueryError
from docspark.queries import TERMS, customer_documents, event_history, load, register, text_index, vector_index
from docspark.sources import files, scratch
from docspark.sources.collection import Collection
from docspark.sources.store import Database
from docspark.streaming import live

# what readers don't see


@register("lazy_ttl", "SELECT 'c:' || c_custkey AS id FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 5 * 100 > 250")
def lazy_ttl(spark, sf_dir):
    docs = customer_documents(spark, sf_dir)
    expires = (_key() % 5) * 100
    return Collection.documents(docs.df.withColumn("expires_at", expires), now_ms=250).query("SELECT id FROM db")


@register("tombstones", "SELECT 'c:' || c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0 AND c_mktsegment = 'BUILDING'")
def tombstones(spark, sf_dir):
    df = customer_documents(spark, sf_dir).df.withColumn("deleted", F.when(_key() % 4 == 0, True))
    return Collection.documents(df).query("SELECT id FROM db WHERE seg = 'BUILDING'")


# stores and files


def _json(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.to_json(F.struct(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))).alias("json"))


def _key() -> Column:
    return F.substring("id", 3, 20).cast("long")


@register("store_writes", """SELECT 'c:' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 2 ELSE 1 END AS hlc,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 7 <> 0""")
def store_writes(spark, sf_dir):
    """Puts, a compaction, compare-and-set writes of which half are stale, and deletions."""
    db, docs = Database(spark, scratch.folder(spark, "db")), _json(spark, sf_dir)
    db.put(docs, "a", 1)
    db.compact()
    third = docs.where(_key() % 3 == 0).select("id", F.lit('{"seg":"new"}').alias("json"))
    db.put(third, "a", 2, third.select("id", F.when(_key() % 2 == 0, 1).otherwise(0).alias("hlc")), partial=True)
    db.put(docs.where(_key() % 7 == 0).select("id", F.lit(None).cast("string").alias("json"), F.lit(True).alias("deleted")), "a", 3)
    return db.current().where(~F.col("deleted")).select("id", F.col("hlc").cast("int").alias("hlc"), F.try_variant_get("body", "$.seg", "string").alias("seg"))


@register("store_results", "SELECT 'c:' || c_custkey AS id, c_custkey % 2 = 0 AS ok, CASE WHEN c_custkey % 2 = 1 THEN 'conflict' END AS error FROM customer")
def store_results(spark, sf_dir):
    db, docs = Database(spark, scratch.folder(spark, "db")), _json(spark, sf_dir)
    db.put(docs, "a", 1)
    return db.put(docs, "a", 2, docs.select("id", (_key() % 2 + 1).alias("hlc")), partial=True).select("id", "ok", "error")


@register("store_branch", "SELECT 'c:' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 3 WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS hlc FROM customer WHERE c_custkey % 5 <> 1")
def store_branch(spark, sf_dir):
    """A branch at clock 1 that writes and deletes, merged into its parent, which has written too."""
    db, docs = Database(spark, scratch.folder(spark, "db")), _json(spark, sf_dir)
    db.put(docs, "a", 1)
    fork = db.branch(scratch.folder(spark, "fork"), 1)
    db.put(docs.where(_key() % 4 == 0), "a", 2)
    fork.put(docs.where(_key() % 5 == 0), "b", 3)
    fork.put(docs.where(_key() % 5 == 1).select("id", "json", F.lit(True).alias("deleted")), "b", 4)
    db.merge(fork)
    return db.current_rows().where(~F.col("deleted")).select("id", F.col("hlc").cast("int").alias("hlc"))


@register("store_info", "SELECT count(*) AS n_writes, count(DISTINCT user_id) AS n_ids, max(event_id) AS last_hlc FROM events")
def store_info(spark, sf_dir):
    db = Database(spark, scratch.folder(spark, "db"))
    e = load(spark, sf_dir, "events")
    db.receive(e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("hlc"), F.lit("a").alias("author"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("expires_at"), F.to_json(F.struct("event_type")).alias("json")))
    return db.info()


@register("store_attachments", "SELECT 'doc' AS id, 'b' AS name, 3::BIGINT AS length, sha256('two') AS digest")
def store_attachments(spark, sf_dir):
    db = Database(spark, scratch.folder(spark, "db"))
    db.put_attachment("doc", "a", "text/plain", b"one", 1)
    db.put_attachment("doc", "b", "text/plain", b"older", 1)
    db.put_attachment("doc", "b", "text/plain", b"two", 2)
    db.delete_attachment("doc", "a", 3)
    return db.attachments("doc").select("id", "name", "length", "digest")


@register("json_files", "SELECT 'c:' || c_custkey AS id, c_mktsegment AS seg, c_custkey AS k FROM customer WHERE c_custkey >= 10")
def json_files(spark, sf_dir):
    """Documents written as JSON lines and read back."""
    path = scratch.folder(spark, "lines")
    docs = _json(spark, sf_dir).select("id", F.parse_json(F.concat(F.lit('{"id":"'), "id", F.lit('",'), F.substring("json", F.lit(2), F.length("json")))).alias("body"))
    files.write_documents(docs, path)
    out = Collection.documents(files.read_documents(spark, path)).query("SELECT seg, k FROM db WHERE k >= 10")
    return out.select("id", F.try_variant_get("seg", "$", "string").alias("seg"), F.try_variant_get("k", "$", "bigint").alias("k"))


@register("doc_formats", "SELECT c_custkey AS id, length('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}')::BIGINT AS size FROM customer")
def doc_formats(spark, sf_dir):
    c = Collection.typed(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return c.find(doc_format="binary", decoder=lambda d: F.octet_length(d).cast("long")).withColumnRenamed("doc", "size")


# the language's edges

_BAD = (
    ("unbound_param", "SELECT id FROM d WHERE a = $x"),
    ("constant_predicate", "SELECT id FROM d WHERE 1 = 2"),
    ("unsupported:path_comparison", "SELECT id FROM d WHERE a = b"),
    ("use_is_null", "SELECT id FROM d WHERE a = NULL"),
    ("reserved_field", "SELECT _x FROM d"),
    ("duplicate_output_name", "SELECT a.b, c.b FROM d"),
    ("alias_required", "SELECT a[0] FROM d"),
    ("unsupported:multi_key_order_by", "SELECT id FROM d ORDER BY a, b"),
    ("unsupported:id_in_disjunction", "SELECT id FROM d WHERE id = 'a' OR b = 1"),
    ("unsupported:wildcard_path", "SELECT id FROM d WHERE a[*] = 1"),
    ("unknown_table_function", "SELECT id FROM nothing('q') AS h"),
    ("invalid_table_fn_arg", "SELECT id FROM bm25_top_k('q', k => 0) AS h"),
    ("unsupported_with_subscribe", "SELECT id FROM d ORDER BY a SUBSCRIBE"),
    ("syntax", "SELECT id FROM d WHERE flag"),
)


@register("rejected", f"SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{r}{chr(39)})' for i, (r, _) in enumerate(_BAD))}) t(n, reason)")
def rejected(spark, sf_dir):
    """The reason codes of queries that are refused; nothing is read."""

    def reason(text: str) -> str:
        try:
            compile_query(text)
        except QueryError as e:
            return e.reason
        return "none"

    return spark.createDataFrame([(i, reason(text)) for i, (_, text) in enumerate(_BAD)], "n int, reason string")


@register("condition_codec", "SELECT c_custkey AS id FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal >= 5000) AND NOT (c_nationkey IN (1, 2, 3)) AND starts_with(c_name, 'Customer#')")
def condition_codec(spark, sf_dir):
    """A condition through its JSON wire form."""
    c = ("and", [("or", [("path", ["c_mktsegment"], "BUILDING"), ("compare", ["c_acctbal"], ">=", 5000)]), ("not", ("in", ["c_nationkey"], [1, 2, 3])), ("prefix", ["c_name"], "Customer#")])
    return Collection.typed(load(spark, sf_dir, "customer"), "c_custkey").find({"where": [conditions.from_json(conditions.to_json(c))], "include_docs": False})


@register("variables_in_or", 'SELECT c_custkey AS id, c_name AS "?N" FROM customer WHERE c_acctbal > 9000 OR c_nationkey = 3')
def variables_in_or(spark, sf_dir):
    """A variable that every branch of a disjunction binds alike is kept."""
    name = ["path", ["c_name"], "?N"]
    where = [["or", [["and", [name, ["compare", ["c_acctbal"], ">", 9000]]], ["and", [name, ["path", ["c_nationkey"], 3]]]]]]
    return Collection.typed(load(spark, sf_dir, "customer"), "c_custkey").find({"where": where, "select": ["*"]})


@register("fold_early_stop", "SELECT c_name AS id FROM customer WHERE c_acctbal > 0 ORDER BY c_name LIMIT 12")
def fold_early_stop(spark, sf_dir):
    c = Collection.typed(load(spark, sf_dir, "customer"), "c_name")
    ids = c.fold("SELECT id FROM customer WHERE c_acctbal > 0 LIMIT 1000", lambda acc, row: ([*acc, row["id"]], len(acc) < 11), [])
    return spark.createDataFrame([(i,) for i in ids], "id string")


@register("doc_functions", "SELECT c_custkey AS id, c_mktsegment AS seg, 'x' AS extra, 2 AS taken, 1 AS filtered, 'name,seg' AS keys FROM customer")
def doc_functions(spark, sf_dir):
    m = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    merged = documents.merge(m, F.create_map(F.lit("extra"), F.lit("x")))
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        at(merged, "seg").alias("seg"),
        at(documents.set_key(merged, "extra", F.lit("x")), "extra").alias("extra"),
        documents.size(documents.take(merged, "seg", "extra", "none")).alias("taken"),
        documents.size(documents.filter_entries(m, lambda k, _: k == "name")).alias("filtered"),
        F.array_join(documents.keys(m), ",").alias("keys"),
    )


# search


@register("hydrate_hits", f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM t), f AS (SELECT doc_id, len(ws) AS dl, len(list_filter(ws, lambda x: x = '{TERMS[0]}')) AS tf FROM t),
d AS (SELECT count(*) FILTER (WHERE tf > 0) AS df FROM f)
SELECT doc_id AS id, lang, source FROM f JOIN documents USING (doc_id), n, d WHERE tf > 0 ORDER BY ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al)) DESC, doc_id LIMIT 8""")
def hydrate_hits(spark, sf_dir):
    hits = text_index(spark, sf_dir).search(TERMS[0], 8)
    return search.hydrate(hits, load(spark, sf_dir, "documents"), "doc_id", ["lang", "source"]).select("id", "lang", "source")


@register("bm25_encode", """WITH t AS (SELECT list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM t), a(term, tf) AS (VALUES ('the', 2), ('of', 1), ('unheardof', 1)),
d AS (SELECT term, tf, (SELECT count(*) FROM t WHERE list_contains(ws, term)) AS raw FROM a)
SELECT term, round(ln((n - greatest(raw, 1) + 0.5) / (greatest(raw, 1) + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 4 / al)), 6) AS weight FROM d, n""")
def bm25_encode(spark, sf_dir):
    return text_index(spark, sf_dir).encode("The of, the unheardof").withColumn("weight", F.round("weight", 6))


@register("vector_crud", "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 99 ELSE label END AS label FROM embeddings WHERE vec_id NOT IN (3, 4)")
def vector_crud(spark, sf_dir):
    index = vector_index(spark, sf_dir)
    new = index.store.where("vec_id % 5 = 0").withColumn("label", F.lit(99).cast(index.store.schema["label"].dataType))
    return index.upsert(new).delete([3, 4]).store.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"))


@register("vector_get", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id = 11")
def vector_get(spark, sf_dir):
    return vector_index(spark, sf_dir).get(11).select(F.col("vec_id").alias("id"), "label")


@register("embed_lengths", "SELECT c_custkey AS id, length(c_name)::DOUBLE AS v FROM customer")
def embed_lengths(spark, sf_dir):
    """A chain whose first provider is down, over batches."""

    def down(texts):
        raise OSError("no provider")

    chain = search.EmbedChain(down, lambda texts: [[float(len(t))] for t in texts])
    return search.embed_column(load(spark, sf_dir, "customer"), "c_name", "v", chain).select(F.col("c_custkey").alias("id"), F.get("v", 0).cast("double").alias("v"))


@register("rerank_hits", "SELECT doc_id AS id, length(text)::DOUBLE AS rerank_score FROM documents WHERE doc_id < 30 AND text IS NOT NULL ORDER BY length(text) DESC, doc_id LIMIT 5")
def rerank_hits(spark, sf_dir):
    hits = load(spark, sf_dir, "documents").where("doc_id < 30 AND text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return search.rerank(hits, lambda _, texts: [float(len(t)) for t in texts], "any", top_k=5).select("id", "rerank_score")


@register("product_codes", "SELECT count(*) AS n, true AS nearer FROM embeddings")
def product_codes(spark, sf_dir):
    """Whether decoded product codes stand nearer to their vectors than the mean vector does, all in all."""
    e = load(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    size = len(e.first()["v"])
    pq = ProductQuantizer(m=4 if size % 4 == 0 else 1, k=16, iterations=5).fit(e, "v")
    mean = [float(x) for x in e.agg(F.array(*[F.avg(F.get("v", i)) for i in range(size)]).alias("m")).first()["m"]]
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    out = e.select(gap(F.col("v"), pq.decode(pq.encode(F.col("v")))).alias("a"), gap(F.col("v"), F.lit(mean).cast("array<double>")).alias("b"))
    return out.agg(F.count(F.lit(1)).alias("n"), (F.sum("a") < F.sum("b")).alias("nearer"))


@register("turbo_codes", "SELECT count(*) AS n, true AS close FROM embeddings")
def turbo_codes(spark, sf_dir):
    """Whether inner products estimated from 4-bit codes correlate with the exact ones above 0.98."""
    from docspark.functions.vectors import dot, literal

    e = load(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    query = list(e.first()["v"])
    q = TurboQuantizer(len(query), 4)
    out = e.select(dot(F.col("v"), literal(query)).alias("x"), q.dot(q.encode(F.col("v")), query).alias("y"))
    return out.agg(F.count(F.lit(1)).alias("n"), (F.corr("x", "y") > 0.98).alias("close"))


# change data


@register("changes_has", "SELECT EXISTS (SELECT 1 FROM events WHERE event_id > 900) AS after_900, EXISTS (SELECT 1 FROM events WHERE event_id > 100000000) AS after_all")
def changes_has(spark, sf_dir):
    h = event_history(spark, sf_dir)
    return spark.createDataFrame([(changes.has_since(h, 900), changes.has_since(h, 100_000_000))], "after_900 boolean, after_all boolean")


@register("mqtt_patterns", """SELECT event_id AS id, event_type = 'click' AS exact, true AS plus, true AS rest, event_type IN ('click', 'error') AS any_of FROM events""")
def mqtt_patterns(spark, sf_dir):
    h, t = event_history(spark, sf_dir), F.col("topics")
    hit = lambda *ps: F.greatest(*[topics.matches(t, p) for p in ps]) if len(ps) > 1 else topics.matches(t, ps[0])
    return h.select(F.col("hlc").alias("id"), hit("event_type/click").alias("exact"), hit("event_type/+").alias("plus"), hit("value/#").alias("rest"), hit("+/click", "+/error").alias("any_of"))


@register("path_subscription", "SELECT event_id AS hlc FROM events WHERE event_type IN ('click', 'purchase') OR round(value)::BIGINT = 7")
def path_subscription(spark, sf_dir):
    h = event_history(spark, sf_dir)
    legs = [live.path_subscription(h, p, "topics").select("hlc") for p in ("event_type/click", "event_type/purchase", "+/7")]
    return legs[0].union(legs[1]).union(legs[2]).distinct()


@register("version_tokens", """WITH t AS (SELECT event_id, lower(lpad(to_hex(epoch_us(ts) // 1000), 16, '0') || lpad(to_hex(event_id), 8, '0')) AS c FROM events)
SELECT event_id AS id, c || '@' || CASE WHEN event_id % 2 = 0 THEN '61' ELSE '62' END AS token, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS author, event_id AS logical, true AS later FROM t""")
def version_tokens(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    author = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    t = clocks.token(clocks.clock(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id")), author)
    older = clocks.token(clocks.clock(F.lit(0), F.lit(0)), F.lit("z"))
    return e.select(F.col("event_id").alias("id"), t.alias("token")).select("id", "token", clocks.token_author(F.col("token")).alias("author"), clocks.token_clock(F.col("token"))["logical"].alias("logical"), (clocks.newest(F.col("token"), older) == F.col("token")).alias("later"))


@register("live_stream", """WITH m AS (SELECT *, (value > 50 AND event_type <> 'error') AS now FROM events),
w AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY user_id ORDER BY event_id), false) AS was FROM m)
SELECT CAST(user_id AS VARCHAR) AS id, event_id AS hlc, CASE WHEN now AND was THEN 'change' WHEN now THEN 'add' ELSE 'remove' END AS event FROM w WHERE now OR was""")
def live_stream(spark, sf_dir):
    """The live query as a stream with state, over the history as a folder that is drained."""
    base = scratch.folder(spark, "live")
    kept = event_history(spark, sf_dir).select("id", "hlc", "value", "deleted")
    kept.write.parquet(f"{base}/in")
    stream = live.history_source(spark, f"{base}/in", "id long, hlc long, value double, deleted boolean", 1000)
    events = live.live(stream, "SELECT value FROM db WHERE value > 50 SUBSCRIBE")
    live.drain(events, lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/b={n}"), f"{base}/at").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "hlc", "event")


@register("outbox", "SELECT event_type AS tag, user_id AS id, max(event_id) AS hlc FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL")
def outbox(spark, sf_dir):
    """One entry a document and tag, delivered from a drained stream."""
    base = scratch.folder(spark, "outbox")
    event_history(spark, sf_dir).select("id", "hlc", "event_type").write.parquet(f"{base}/in")
    stream = live.history_source(spark, f"{base}/in", "id long, hlc long, event_type string", 1000)
    tags = {t: F.col("event_type") == t for t in ("click", "purchase")}
    handler = live.outbox_batches(tags, lambda tag, df: df.withColumn("tag", F.lit(tag)).write.mode("append").parquet(f"{base}/out"))
    live.drain(stream, handler, f"{base}/at").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("tag", "id", "hlc")


@register("index_handler", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT user_id AS id, CASE WHEN event_type <> 'error' THEN length(event_type)::DOUBLE END AS v, event_type = 'error' AS removed FROM l WHERE rn = 1""")
def index_handler(spark, sf_dir):
    """Vectors saved and ids removed by the indexing handler over one batch."""
    base = scratch.folder(spark, "index")
    save = lambda df: df.select("id", F.get("v", 0).cast("double").alias("v"), F.lit(False).alias("removed")).write.mode("append").parquet(base)
    remove = lambda df: df.select("id", F.lit(None).cast("double").alias("v"), F.lit(True).alias("removed")).write.mode("append").parquet(base)
    live.index_batches("event_type", "v", search.EmbedChain(lambda texts: [[float(len(t))] for t in texts]), save, remove)(event_history(spark, sf_dir).select("id", "hlc", "deleted", "event_type"), 0)
    return spark.read.parquet(base)


# sessions


@register("session_list", "SELECT conv_id AS id FROM (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) WHERE last + 3 > 6 AND conv_id % 2 = 0")
def session_list(spark, sf_dir):
    s = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("touched")).withColumn("agent", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    return sessions.live_sessions(s, 6, "even", 3).select("id")


@register("handoffs", "SELECT o_orderkey AS id, o_custkey AS chain_root FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'")
def handoffs(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chain_root"), F.lit(0).alias("chain_depth"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("to"))
    return sessions.handoffs(o, status="P", to="2-HIGH").select("id", "chain_root")


@register("session_data", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events WHERE user_id % 10 = 1) SELECT event_type AS key, value FROM l WHERE rn = 1 AND value IS NOT NULL")
def session_data(spark, sf_dir):
    e = load(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("session"), F.col("event_id").alias("ts"), F.col("event_type").alias("key"), "value")
    return sessions.data_map(e, 1)
