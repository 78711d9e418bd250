"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import clocks, documents, topics, vectors
from docspark.operators import ann, changes, replication, search, sessions
from docspark.sources import scratch
from docspark.sources.collection import Collection
from docspark.streaming import live

QUERIES, ORACLES = {}, {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _text(name: str, table: str, key: str, bql: str, sql: str, params: dict | None = None, json_columns: tuple[str, ...] = (), cast: dict[str, str] | None = None):
    """A query given as text over one typed table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Collection.typed(load(spark, sf_dir, table), key, json_columns).query(bql, params)
        for c, kind in (cast or {}).items():
            out = out.withColumn(c, F.try_variant_get(c, "$", kind))
        return out

    register(name, sql)(run)


O, P, C = ("orders", "o_orderkey"), ("part", "p_partkey"), ("customer", "c_custkey")
_text("eq", *O, "SELECT o_orderstatus FROM orders WHERE o_orderstatus = 'F'", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
_text("eq_integer", *P, "SELECT p_size FROM part AS p WHERE p.p_size = 15", "SELECT p_partkey AS id, p_size FROM part WHERE p_size = 15")
_text("eq_strict_types", *P, "SELECT p_size FROM part WHERE p_size = 15.0 OR p_retailprice = 1000 OR p_name = 3", "SELECT p_partkey AS id, p_size FROM part WHERE false")
_text("neq", *O, "SELECT o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'", "SELECT o_orderkey AS id, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'")
_text("range", *O, "SELECT o_totalprice FROM orders WHERE o_totalprice >= $low AND 200000 > o_totalprice", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000", {"low": 100000})
_text("range_time", *O, "SELECT o_totalprice FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
_text("between", *O, "SELECT o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
_text("not_between", *O, "SELECT o_totalprice FROM orders WHERE o_totalprice NOT BETWEEN 5000 AND 400000", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_totalprice NOT BETWEEN 5000 AND 400000")
_text("in_set", *P, "SELECT p_type FROM part WHERE p_size IN (1, 7, 49)", "SELECT p_partkey AS id, p_type FROM part WHERE p_size IN (1, 7, 49)")
_text("not_in", *O, "SELECT o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "SELECT o_orderkey AS id, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
_text("like_prefix", *C, "SELECT c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'", "SELECT c_custkey AS id, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
_text("like_regex", *P, "SELECT p_brand FROM part WHERE p_brand LIKE '%#_2'", "SELECT p_partkey AS id, p_brand FROM part WHERE regexp_matches(p_brand, '^.*#.2$')")
_text("not_like", *C, "SELECT c_mktsegment FROM customer WHERE c_mktsegment NOT LIKE '%B%'", "SELECT c_custkey AS id, c_mktsegment FROM customer WHERE c_mktsegment NOT LIKE '%B%'")
_text("or_not_dualized", *O, "SELECT o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000)", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice <= 100000")
_text("or_and", *O, "SELECT o_orderstatus FROM orders WHERE o_orderstatus IN ('P') OR o_orderpriority = '1-URGENT' AND o_totalprice <= 30000", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus IN ('P') OR (o_orderpriority = '1-URGENT' AND o_totalprice <= 30000)")
_text("json_path", "events", "event_id", "SELECT props.k AS k FROM events WHERE props.k >= 50", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50", json_columns=("props",), cast={"k": "bigint"})
_text("json_eq", "events", "event_id", "SELECT event_type FROM events WHERE props.k = 7", "SELECT event_id AS id, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7", json_columns=("props",))
_text("id_eq", "customer", "c_name", "SELECT c_acctbal FROM customer WHERE id = 'Customer#000000042'", "SELECT c_name AS id, c_acctbal FROM customer WHERE c_name = 'Customer#000000042'")
_text("id_range", "customer", "c_name", "SELECT c_acctbal FROM customer WHERE id >= 'Customer#000000100' AND id < 'Customer#000000200' AND c_acctbal > 0", "SELECT c_name AS id, c_acctbal FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200' AND c_acctbal > 0")
_text("id_range_empty", "customer", "c_name", "SELECT c_acctbal FROM customer WHERE id >= 'z' AND id < 'a'", "SELECT c_name AS id, c_acctbal FROM customer WHERE false")
_text("id_prefix", "customer", "c_name", "SELECT c_acctbal FROM customer WHERE id LIKE 'Customer#0000001%'", "SELECT c_name AS id, c_acctbal FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
_text("top_k", *O, "SELECT o_totalprice AS total, o_orderpriority FROM orders AS o WHERE o.o_orderstatus = 'F' AND o.o_totalprice >= 100000 ORDER BY o.o_totalprice DESC LIMIT 10", "SELECT o_orderkey AS id, o_totalprice AS total, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 10")
_text("order_offset_limit", *O, "SELECT o_orderdate FROM orders ORDER BY o_orderdate LIMIT 20 OFFSET 5", "SELECT o_orderkey AS id, o_orderdate FROM orders ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR) LIMIT 20 OFFSET 5")
_text("limit_zero", *O, "SELECT o_orderdate FROM orders LIMIT 0", "SELECT o_orderkey AS id, o_orderdate FROM orders LIMIT 0")
_text("select_star", *P, "SELECT * FROM part WHERE p_size = 3", "SELECT * FROM part WHERE p_size = 3")


def customer_documents(spark: SparkSession, sf_dir: str) -> Collection:
    """Documents with an absent, a null or a present balance, and nested fields."""
    c = load(spark, sf_dir, "customer")
    key, bal = F.col("c_custkey"), F.col("c_acctbal").cast("string")
    balance = F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, F.lit(',"bal":null')).otherwise(F.concat(F.lit(',"bal":'), bal))
    text = F.concat(F.lit('{"type":"customer","seg":"'), "c_mktsegment", F.lit('","address":{"nation":'), F.col("c_nationkey").cast("string"), F.lit("}"), balance, F.lit("}"))
    return Collection.documents(c.select(F.concat(F.lit("c:"), key.cast("string")).alias("id"), F.parse_json(text).alias("body")))


def _docs(name: str, where: str, sql: str):
    register(name, f"SELECT 'c:' || c_custkey AS id FROM customer WHERE {sql}")(lambda spark, sf_dir: customer_documents(spark, sf_dir).query(f"SELECT id FROM db WHERE {where}"))


_docs("is_missing", "bal IS MISSING", "c_custkey % 3 = 0")
_docs("is_not_missing", "bal IS NOT MISSING", "c_custkey % 3 <> 0")
_docs("is_null", "bal IS NULL", "c_custkey % 3 <> 2")
_docs("is_not_null", "bal IS NOT NULL", "c_custkey % 3 = 2")
_docs("nested_path", "address.nation = 7 AND seg = 'BUILDING'", "c_nationkey = 7 AND c_mktsegment = 'BUILDING'")
_docs("missing_not", "NOT bal < 0", "c_custkey % 3 = 2 AND c_acctbal >= 0")
_docs("mixed_compare", "bal > 1000 OR seg > 1000 OR NOT seg = 5 AND address.nation < 'x'", "c_custkey % 3 = 2 AND c_acctbal > 1000")


@register("doc_order", "SELECT 'c:' || c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN c_acctbal END AS bal FROM customer ORDER BY CASE WHEN c_custkey % 3 = 2 THEN 0 ELSE 2 END DESC, CASE WHEN c_custkey % 3 = 2 THEN c_acctbal END DESC, 'c:' || c_custkey LIMIT 700")
def doc_order(spark, sf_dir):
    out = customer_documents(spark, sf_dir).query("SELECT bal FROM db ORDER BY bal DESC LIMIT 700")
    return out.withColumn("bal", F.try_variant_get("bal", "$", "double"))


def order_documents(spark: SparkSession, sf_dir: str) -> Collection:
    """Orders with their lines as an array of structs and their flags as an array."""
    line = F.struct(*[F.col(f"l_{c}").alias(c) for c in ("linenumber", "quantity", "returnflag")])
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    orders = load(spark, sf_dir, "orders")
    return Collection.typed(orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").drop("l_orderkey"), "o_orderkey")


def _orders(name: str, bql: str, sql: str):
    register(name, sql)(lambda spark, sf_dir: order_documents(spark, sf_dir).query(bql))


_JOINED = "orders JOIN lineitem ON l_orderkey = o_orderkey"
_orders("unnest", "SELECT t.quantity AS quantity, o.o_orderstatus FROM orders AS o, UNNEST(o.lines) AS t", f"SELECT o_orderkey AS id, l_quantity AS quantity, o_orderstatus FROM {_JOINED}")
_orders("unnest_pred", "SELECT t.linenumber AS n FROM orders AS o, UNNEST(o.lines) AS t WHERE o.o_orderstatus = 'O' AND (t.quantity >= 45 OR t.returnflag = 'R')", f"SELECT o_orderkey AS id, l_linenumber AS n FROM {_JOINED} WHERE o_orderstatus = 'O' AND (l_quantity >= 45 OR l_returnflag = 'R')")
_orders("unnest_order", "SELECT t.quantity AS quantity FROM orders AS o, UNNEST(o.lines) AS t WHERE t.linenumber = 1 ORDER BY t.quantity DESC LIMIT 30", f"SELECT o_orderkey AS id, l_quantity AS quantity FROM {_JOINED} WHERE l_linenumber = 1 ORDER BY l_quantity DESC, CAST(o_orderkey AS VARCHAR) LIMIT 30")
_orders("contains", "SELECT o_orderstatus FROM orders WHERE CONTAINS(flags, 'R')", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
_orders("member_eq", "SELECT o_orderstatus FROM orders WHERE flags = 'N'", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
_orders("lit_in_path", "SELECT o_orderstatus FROM orders WHERE 'A' IN flags", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
_orders("array_index", "SELECT lines[0].quantity AS q FROM orders WHERE lines[0].quantity > 40", f"SELECT o_orderkey AS id, l_quantity AS q FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) AS rn FROM {_JOINED}) WHERE rn = 1 AND l_quantity > 40")


@register("find_vars", 'SELECT c_custkey AS id, c_name AS "?Name", c_nationkey AS "?Nation" FROM customer WHERE c_acctbal > 5000')
def find_vars(spark, sf_dir):
    spec = {"where": [["path", ["c_name"], "?Name"], ["path", ["c_nationkey"], "?Nation"], ["compare", ["c_acctbal"], ">", 5000]], "select": ["*"]}
    return Collection.typed(load(spark, sf_dir, "customer"), "c_custkey").find(spec)


@register("var_compare", "SELECT l_orderkey AS id, l_linenumber FROM lineitem WHERE l_discount > l_tax")
def var_compare(spark, sf_dir):
    spec = {"where": [["path", ["l_tax"], "?Tax"], ["compare", ["l_discount"], ">", "?Tax"]], "select": [["l_linenumber"]]}
    return Collection.typed(load(spark, sf_dir, "lineitem"), "l_orderkey").find(spec)


@register("find_not", "SELECT c_custkey AS id, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' AND NOT regexp_matches(c_name, '7$') ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 50")
def find_not(spark, sf_dir):
    spec = {"where": [["not", ["path", ["c_mktsegment"], "BUILDING"]], ["not", ["regex", ["c_name"], "7$"]]], "select": [["c_mktsegment"]], "order_by": (["c_acctbal"], "desc"), "limit": 50}
    return Collection.typed(load(spark, sf_dir, "customer"), "c_custkey").find(spec)


@register("keyset_page", "SELECT c_name AS id FROM customer WHERE c_acctbal > 0 ORDER BY c_name LIMIT 25 OFFSET 25")
def keyset_page(spark, sf_dir):
    c = Collection.typed(load(spark, sf_dir, "customer"), "c_name")
    spec = {"where": [["compare", ["c_acctbal"], ">", 0]], "include_docs": False}
    first, after = c.page(spec, 25)
    return c.page(spec, 25, after([r["id"] for r in first.collect()]))[0]


@register("get_docs", "SELECT a.asked, c_acctbal FROM (VALUES ('7'), ('3'), ('-1')) a(asked) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = a.asked")
def get_docs(spark, sf_dir):
    return Collection.typed(load(spark, sf_dir, "customer"), "c_custkey").get_docs(["7", "3", "-1"]).select("asked", "c_acctbal")


# search

_COSINE = "list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))"
_VECTOR_HITS = f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0),
s AS (SELECT vec_id AS id, label, {_COSINE} AS score FROM v, q)"""
TERMS = ("the", "tion", "of")


def vector_index(spark, sf_dir) -> search.VectorIndex:
    return search.VectorIndex(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in load(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def text_index(spark, sf_dir) -> search.BM25:
    return search.BM25(load(spark, sf_dir, "documents"), "doc_id", "text")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@register("vector_search", f"WITH {_VECTOR_HITS} SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10")
def vector_search(spark, sf_dir):
    return _rounded(vector_index(spark, sf_dir).search(query_vector(spark, sf_dir), 10).select("id", "score"))


def lists(spark, sf_dir) -> ann.InvertedLists:
    return ann.InvertedLists(spark, scratch.folder(spark, "lists")).build(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@register("ann_all_lists", f"WITH {_VECTOR_HITS} SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10")
def ann_all_lists(spark, sf_dir):
    """Inverted lists, all of them probed: the exact answer."""
    return _rounded(lists(spark, sf_dir).search(query_vector(spark, sf_dir), 10, probes=1 << 20).select("id", "score"))


@register("ann_recall", "SELECT 20 AS queries, true AS enough")
def ann_recall(spark, sf_dir):
    """Whether a probe of some lists finds 0.9 of the ten nearest of 20 stored vectors."""
    index, store = lists(spark, sf_dir), vector_index(spark, sf_dir)
    asked = [r for r in load(spark, sf_dir, "embeddings").where("vec_id < 20").collect()]
    legs = []
    for r in asked:
        v = [float(x) for x in r["embedding"]]
        near = index.search(v, 10).select("id").withColumn("q", F.lit(r["vec_id"]))
        legs.append(near.join(store.search(v, 10).select("id"), "id"))
    hits = functools.reduce(DataFrame.unionByName, legs)
    return hits.agg(F.lit(len(asked)).alias("queries"), (F.count(F.lit(1)) >= 0.9 * 10 * len(asked)).alias("enough"))


@register("vector_filter", f"WITH {_VECTOR_HITS}, k AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 30) SELECT id, round(score, 6) AS score FROM k WHERE label = 3")
def vector_filter(spark, sf_dir):
    return _rounded(vector_index(spark, sf_dir).search(query_vector(spark, sf_dir), 30, F.col("label") == 3).select("id", "score"))


@register("vector_euclidean", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0) SELECT vec_id AS id, round(1 - list_distance(e, q), 6) AS score FROM v, q ORDER BY 1 - list_distance(e, q) DESC, vec_id LIMIT 10")
def vector_euclidean(spark, sf_dir):
    index = search.VectorIndex(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", "euclidean")
    return _rounded(index.search(query_vector(spark, sf_dir), 10).select("id", "score"))


@register("int8_quantize", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings)
SELECT vec_id AS id, round(m, 6) AS scale, array_to_string(list_transform(e, lambda x: round(x / m * 127)::BIGINT), ',') AS codes FROM v""")
def int8_quantize(spark, sf_dir):
    q = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vectors.quantize_int8(F.col("embedding")).alias("q"))
    return q.select("id", F.round("q.scale", 6).alias("scale"), F.array_join(F.transform("q.codes", lambda c: c.cast("string")), ",").alias("codes"))


def _bm25_sql(terms: tuple[str, ...]) -> str:
    asked = ", ".join(f"('{t}')" for t in sorted(set(terms)))
    return f"""t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM t), a(term) AS (VALUES {asked}),
f AS (SELECT doc_id, len(ws) AS dl, term, len(list_filter(ws, lambda x: x = term)) AS tf FROM t, a),
d AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY term),
b AS (SELECT doc_id AS id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score FROM f JOIN d USING (term), n WHERE tf > 0 GROUP BY doc_id)"""


@register("bm25_search", f"WITH {_bm25_sql(TERMS)} SELECT id, round(score, 6) AS score FROM b ORDER BY b.score DESC, id LIMIT 10")
def bm25_search(spark, sf_dir):
    return _rounded(text_index(spark, sf_dir).search(" ".join(TERMS), 10))


@register("bm25_stats", "WITH t AS (SELECT list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), lambda x: x <> '') AS ws FROM documents) SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_tokens, round(avg(len(ws)), 6) AS avg_len FROM t")
def bm25_stats(spark, sf_dir):
    return text_index(spark, sf_dir).stats().withColumn("avg_len", F.round("avg_len", 6))


@register("bm25_frequency", "WITH t AS (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), lambda x: x <> ''))) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def bm25_frequency(spark, sf_dir):
    return text_index(spark, sf_dir).document_frequency()


_WEIGHTS_SQL = """t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM t), f AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM t),
g AS (SELECT doc_id, dl, term, count(*) AS tf FROM f GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM g GROUP BY term),
w AS (SELECT doc_id AS id, term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al)) AS weight FROM g JOIN d USING (term), n)"""


@register("bm25_weights", f"WITH {_WEIGHTS_SQL} SELECT id, term, round(weight, 6) AS weight FROM w")
def bm25_weights(spark, sf_dir):
    return text_index(spark, sf_dir).weights().withColumn("weight", F.round("weight", 6))


@register("bm25_get_vector", f"WITH {_WEIGHTS_SQL} SELECT term, round(weight, 6) AS weight FROM w WHERE id = 7")
def bm25_get_vector(spark, sf_dir):
    return text_index(spark, sf_dir).get_vector(7).withColumn("weight", F.round("weight", 6))


@register("bm25_indexed", f"WITH {_bm25_sql(TERMS)} SELECT CAST(id AS VARCHAR) AS id, round(score, 6) AS score FROM b ORDER BY b.score DESC, CAST(id AS VARCHAR) LIMIT 10")
def bm25_indexed(spark, sf_dir):
    """The same search over stored postings, after an update of some documents and a merge of the segments."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    index = search.TermIndex(spark, scratch.folder(spark, "terms"))
    index.add(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("an older text of the document")).otherwise(F.col("text"))), "doc_id")
    index.add(docs.where("doc_id % 3 = 0"), "doc_id")
    return _rounded(index.merge(scratch.folder(spark, "terms")).search(" ".join(TERMS), 10))


def searchable(spark, sf_dir) -> Collection:
    """Documents with text search and the stored vectors under the same ids; the query text maps to vector 0."""
    vector = query_vector(spark, sf_dir)
    index = search.SearchIndex(text_index(spark, sf_dir), vector_index(spark, sf_dir), lambda _: vector)
    return Collection.typed(load(spark, sf_dir, "documents"), "doc_id", search=index)


@register("bm25_top_k", f"WITH {_bm25_sql(TERMS)} SELECT id, lang, round(score, 6) AS score FROM b JOIN documents ON doc_id = id ORDER BY b.score DESC, id LIMIT 5")
def bm25_top_k(spark, sf_dir):
    return _rounded(searchable(spark, sf_dir).query("SELECT lang, _score AS score FROM bm25_top_k('the tion of', k => 5) AS h"))


@register("bm25_where", f"WITH {_bm25_sql(TERMS)}, h AS (SELECT * FROM b ORDER BY score DESC, id LIMIT 30) SELECT id, round(score, 6) AS score FROM h JOIN documents ON doc_id = id WHERE source = 'src1' ORDER BY h.score DESC, id LIMIT 10")
def bm25_where(spark, sf_dir):
    return _rounded(searchable(spark, sf_dir).query("SELECT _score AS score FROM bm25_top_k($q) AS h WHERE h.source = 'src1'", {"q": "the tion of"}))


@register("vector_top_k", f"WITH {_VECTOR_HITS}, h AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 30) SELECT id, round(1 - score, 6) AS dist, lang FROM h JOIN documents ON doc_id = id WHERE lang <> 'fr' ORDER BY h.score DESC, id LIMIT 10")
def vector_top_k(spark, sf_dir):
    out = searchable(spark, sf_dir).query("SELECT _distance AS dist, lang FROM vector_top_k('zero', k => 10, ef_search => 64) AS h WHERE h.lang != 'fr' ORDER BY _distance")
    return out.withColumn("dist", F.round("dist", 6))


_LEGS = f"""{_bm25_sql(TERMS)}, {_VECTOR_HITS},
bt AS (SELECT id, score AS st, row_number() OVER (ORDER BY score DESC, id) AS rt FROM b ORDER BY score DESC, id LIMIT 20),
vt AS (SELECT id, score AS sv, row_number() OVER (ORDER BY score DESC, id) AS rv FROM s ORDER BY score DESC, id LIMIT 20)"""


@register("hybrid_rrf", f"WITH {_LEGS}, m AS (SELECT id, 0.5 / (60 + coalesce(rt, 1000)) + 0.5 / (60 + coalesce(rv, 1000)) AS score FROM bt FULL JOIN vt USING (id)) SELECT id, round(score, 6) AS score FROM m ORDER BY m.score DESC, id LIMIT 10")
def hybrid_rrf(spark, sf_dir):
    return _rounded(searchable(spark, sf_dir).query("SELECT _score AS score FROM hybrid_top_k('the tion of', k => 10) AS h"))


@register("hybrid_linear", f"WITH {_LEGS}, m AS (SELECT id, 0.3 * coalesce(st, 0) / greatest((SELECT max(st) FROM bt), 0.001) + 0.7 * coalesce(sv, 0) AS score FROM bt FULL JOIN vt USING (id)) SELECT id, round(score, 6) AS score FROM m ORDER BY m.score DESC, id LIMIT 10")
def hybrid_linear(spark, sf_dir):
    index = searchable(spark, sf_dir).search
    return _rounded(index.search_hybrid(" ".join(TERMS), 10, fusion="linear", text_weight=0.3, vector_weight=0.7))


# change data: events are writes of documents named by user_id, ordered by (ts, event_id)


def event_history(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("hlc"), F.col("ts"), "event_type", "value", (F.col("event_type") == "error").alias("deleted"), topics.of_fields({"event_type": F.col("event_type"), "value": F.round("value").cast("long")}).alias("topics"))


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)"
_SHOW = ("id", "hlc", "event_type", "value")
_SHOW_SQL = "user_id AS id, event_id AS hlc, event_type, value"


@register("changes_since", f"SELECT {_SHOW_SQL} FROM {_LATEST} WHERE event_id > 500")
def changes_since(spark, sf_dir):
    return changes.changes(event_history(spark, sf_dir), since=500).select(*_SHOW)


@register("changes_limit_desc", f"SELECT {_SHOW_SQL} FROM {_LATEST} ORDER BY event_id LIMIT 20")
def changes_limit_desc(spark, sf_dir):
    return changes.changes(event_history(spark, sf_dir), limit=20, descending=True).select(*_SHOW)


@register("changes_doc_ids", f"SELECT {_SHOW_SQL} FROM {_LATEST} WHERE user_id IN (1, 2, 3)")
def changes_doc_ids(spark, sf_dir):
    return changes.changes(event_history(spark, sf_dir), doc_ids=[1, 2, 3]).select(*_SHOW)


@register("changes_topic", f"SELECT {_SHOW_SQL} FROM {_LATEST} WHERE event_type = 'click' OR round(value)::BIGINT BETWEEN 10 AND 19")
def changes_topic(spark, sf_dir):
    return changes.changes(event_history(spark, sf_dir), paths=["event_type/click", *[f"value/{n}" for n in range(10, 20)]], topics_col="topics").select(*_SHOW)


@register("changes_query", f"SELECT {_SHOW_SQL} FROM {_LATEST} WHERE value > 50 AND event_type <> 'error'")
def changes_query(spark, sf_dir):
    h = event_history(spark, sf_dir)
    hit = Collection.typed(h, "id").matches([["compare", ["value"], ">", 50], ["not", ["path", ["event_type"], "error"]]])
    return changes.changes(h, matching=hit).select(*_SHOW)


def shared_clocks(spark, sf_dir) -> DataFrame:
    """The events under clocks that seven writes share."""
    return event_history(spark, sf_dir).withColumn("author", F.col("hlc")).withColumn("hlc", F.floor(F.col("author") / 7).cast("long"))


_SHARED = "(SELECT user_id AS id, event_id // 7 AS hlc, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 7 DESC, event_id DESC) AS rn FROM events)"


@register("changes_page", f"SELECT id, hlc, event_type FROM {_SHARED} WHERE rn = 1 ORDER BY hlc, id LIMIT 20 OFFSET 20")
def changes_page(spark, sf_dir):
    """The second page of a feed whose clocks tie, from the first page's token."""
    h = shared_clocks(spark, sf_dir)
    _, token, _ = changes.page(h, None, 20)
    return changes.changes(h, since=token, limit=20).select("id", "hlc", "event_type")


@register("changes_main", f"SELECT id, hlc FROM {_SHARED} WHERE rn = 1 AND event_type <> 'error'")
def changes_main(spark, sf_dir):
    return changes.changes(shared_clocks(spark, sf_dir), style="main", include_docs=False).select("id", "hlc")


@register("channel_named", """WITH m AS (SELECT *, event_type IN ('click', 'purchase') AS now FROM events),
w AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY user_id ORDER BY event_id), false) AS was FROM m),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM w WHERE now OR was)
SELECT user_id AS id, event_id AS hlc FROM l WHERE rn = 1 AND (now OR event_type = 'error')""")
def channel_named(spark, sf_dir):
    c = changes.Channels(clicks=["event_type/click"], buys=["event_type/click", "event_type/purchase"])
    return c.feed(event_history(spark, sf_dir), "buys", "topics", include_leaves=False).select("id", "hlc")


@register("changes_count", f"SELECT count(*) AS n FROM {_LATEST} WHERE event_id > 700")
def changes_count(spark, sf_dir):
    return changes.count_since(event_history(spark, sf_dir), 700)


@register("history_range", f"SELECT {_SHOW_SQL} FROM events WHERE event_id BETWEEN 100 AND 300")
def history_range(spark, sf_dir):
    return changes.history_range(event_history(spark, sf_dir), 100, 300).select(*_SHOW)


@register("doc_versions", "SELECT user_id AS id, event_id AS hlc, CASE WHEN event_id = max(event_id) OVER (PARTITION BY user_id) THEN 'current' ELSE 'superseded' END AS status FROM events")
def doc_versions(spark, sf_dir):
    return changes.versions(event_history(spark, sf_dir)).select("id", "hlc", "status")


@register("pitr", f"SELECT {_SHOW_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id <= 600) WHERE rn = 1 AND event_type <> 'error'")
def pitr(spark, sf_dir):
    return changes.as_of(event_history(spark, sf_dir), 600).select(*_SHOW)


@register("channel_leave", """WITH m AS (SELECT *, event_type = 'click' AS now, event_type = 'error' AS dead FROM events),
w AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY user_id ORDER BY event_id), false) AS was FROM m),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM w WHERE now OR was)
SELECT user_id AS id, event_id AS hlc, (NOT now AND NOT dead) AS "left" FROM l WHERE rn = 1""")
def channel_leave(spark, sf_dir):
    return changes.channel_feed(event_history(spark, sf_dir), ["event_type/click"], "topics").select("id", "hlc", "left")


@register("retention", "SELECT user_id AS id, event_id AS hlc FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_id > 500 OR (event_id = last AND event_type <> 'error')")
def retention(spark, sf_dir):
    return changes.retain(event_history(spark, sf_dir), 500).select("id", "hlc")


@register("ttl_sweep", f"SELECT user_id AS id, event_id AS hlc, true AS deleted FROM {_LATEST} WHERE event_type <> 'error' AND value > 0 AND floor(value) BETWEEN 1 AND 40")
def ttl_sweep(spark, sf_dir):
    h = event_history(spark, sf_dir).withColumn("expires", F.floor("value"))
    return changes.expire(h, 40, "expires").select("id", "hlc", "deleted")


@register("live_events", """WITH m AS (SELECT *, (value > 50 AND event_type <> 'error') AS now FROM events),
w AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY user_id ORDER BY event_id), false) AS was FROM m)
SELECT CAST(user_id AS VARCHAR) AS id, event_id AS hlc, CASE WHEN now AND was THEN 'change' WHEN now THEN 'add' ELSE 'remove' END AS event FROM w WHERE now OR was""")
def live_events(spark, sf_dir):
    return live.replay(event_history(spark, sf_dir), "SELECT value FROM db WHERE value > 50 SUBSCRIBE").select("id", "hlc", "event")


@register("query_subscription", f"SELECT {_SHOW_SQL} FROM events WHERE event_type = 'purchase' AND value > 20")
def query_subscription(spark, sf_dir):
    h = event_history(spark, sf_dir)
    return live.query_subscription(h, Collection.typed(h, "id").matches([["path", ["event_type"], "purchase"], ["compare", ["value"], ">", 20]])).select(*_SHOW)


def event_versions(spark, sf_dir) -> DataFrame:
    """Events as versions by two authors."""
    author = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    return load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), author.alias("author"), F.col("event_id").alias("hlc"), (F.col("event_type") == "error").alias("deleted"), F.col("event_type").alias("body"))


@register("replicate_diff", """WITH v AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS author, event_id AS hlc FROM events)
SELECT * FROM v s WHERE NOT EXISTS (SELECT 1 FROM v t WHERE t.id = s.id AND t.author = s.author AND t.hlc >= s.hlc AND t.hlc <= 400)""")
def replicate_diff(spark, sf_dir):
    v = event_versions(spark, sf_dir)
    return replication.missing(v, v.where("hlc <= 400")).select("id", "author", "hlc")


@register("version_vectors", "SELECT CAST(user_id AS VARCHAR) AS id, max(event_id) FILTER (WHERE event_id % 2 = 0) AS a, max(event_id) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY user_id")
def version_vectors(spark, sf_dir):
    vv = replication.vectors(event_versions(spark, sf_dir))
    return vv.select("id", F.try_element_at("vv", F.lit("a")).alias("a"), F.try_element_at("vv", F.lit("b")).alias("b"))


@register("version_status", """WITH v AS (SELECT user_id, event_id, event_id % 2 AS author, event_id = max(event_id) OVER (PARTITION BY user_id) AS last, max(event_id) OVER (PARTITION BY user_id, event_id % 2) AS own FROM events)
SELECT CAST(user_id AS VARCHAR) AS id, event_id AS hlc, CASE WHEN last THEN 'current' WHEN event_id < own THEN 'superseded' ELSE 'conflict' END AS status FROM v""")
def version_status(spark, sf_dir):
    return changes.versions(event_versions(spark, sf_dir), author_col="author").select("id", "hlc", "status")


@register("replicate_batches", "SELECT CAST(user_id AS VARCHAR) AS id, event_id AS hlc, event_type AS body FROM events WHERE event_id <= 400 OR event_type = 'purchase'")
def replicate_batches(spark, sf_dir):
    """A filtered replication in three batches to a target that holds the first writes."""
    path, v, at = scratch.folder(spark, "replica"), event_versions(spark, sf_dir), []
    write = lambda df: df.write.mode("append").parquet(path)
    write(v.where("hlc <= 400"))
    n = v.count()
    job = replication.Replicator(lambda: v, lambda: spark.read.parquet(path), write, lambda: at[-1] if at else None, at.append, -(-n // 3), F.col("body") == "purchase")
    job.run()
    return spark.read.parquet(path).select("id", "hlc", "body")


@register("last_write_wins", f"SELECT CAST(user_id AS VARCHAR) AS id, event_id AS hlc, event_type AS body FROM {_LATEST}")
def last_write_wins(spark, sf_dir):
    return replication.last_write_wins(event_versions(spark, sf_dir)).select("id", "hlc", "body")


@register("merge_branch", "SELECT CAST(user_id AS VARCHAR) AS id, event_id AS hlc, event_type AS body FROM events WHERE event_id <= 800 OR event_type = 'click'")
def merge_branch(spark, sf_dir):
    v = event_versions(spark, sf_dir)
    fork = replication.branch(v, 500).unionByName(v.where("hlc > 500 AND body = 'click'"))
    return replication.merge_branch(v.where("hlc <= 800"), fork, 500).select("id", "hlc", "body")


@register("clock_tokens", "SELECT event_id AS id, lower(lpad(to_hex(epoch_us(ts) // 1000), 16, '0') || lpad(to_hex(event_id), 8, '0')) AS token FROM events")
def clock_tokens(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), clocks.encode(clocks.clock(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id"))).alias("token"))


@register("session_messages", "SELECT turn, role, text FROM conversations WHERE conv_id = 3 AND turn >= 1 AND turn < 6")
def session_messages(spark, sf_dir):
    return sessions.messages(load(spark, sf_dir, "conversations"), 3, 1, 6, session_col="conv_id", ts_col="turn").select("turn", "role", "text")


@register("path_diff", """WITH o AS (SELECT user_id, event_id, event_type AS new, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events)
SELECT event_id AS id, CASE WHEN old IS NULL OR old <> new THEN 'event_type/' || new ELSE '' END AS added, CASE WHEN old <> new THEN 'event_type/' || old ELSE '' END AS removed FROM o""")
def path_diff(spark, sf_dir):
    from pyspark.sql import Window

    h = load(spark, sf_dir, "events").withColumn("topics", topics.of_fields({"event_type": F.col("event_type")}))
    h = h.withColumn("old", F.lag("topics").over(Window.partitionBy("user_id").orderBy("event_id")))
    return h.select(F.col("event_id").alias("id"), F.array_join(topics.added(F.col("old"), F.col("topics")), ",").alias("added"), F.array_join(topics.removed(F.col("old"), F.col("topics")), ",").alias("removed"))


@register("explain_strategy", "SELECT * FROM (VALUES ('index_seek'), ('multi_index'), ('index_scan'), ('full_scan'), ('id_prefix')) t(strategy)")
def explain_strategy(spark, sf_dir):
    c = Collection.typed(load(spark, sf_dir, "orders"), "o_orderkey")
    asked = ("o_orderstatus = 'F'", "o_orderstatus = 'F' AND o_totalprice > 3", "o_totalprice > 3", None, "id LIKE '12%'")
    return spark.createDataFrame([(c.plan("SELECT id FROM orders" + (f" WHERE {w}" if w else "")).strategy(),) for w in asked], "strategy string")




# sets of ids, statistics and smaller operators


def _ids(spark, sf_dir, condition: list) -> DataFrame:
    return Collection.typed(load(spark, sf_dir, "orders"), "o_orderkey").find({"where": [condition], "include_docs": False})


@register("ids_intersect", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def ids_intersect(spark, sf_dir):
    return _ids(spark, sf_dir, ["path", ["o_orderstatus"], "F"]).intersect(_ids(spark, sf_dir, ["path", ["o_orderpriority"], "2-HIGH"]))


@register("ids_union", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '2-HIGH'")
def ids_union(spark, sf_dir):
    return _ids(spark, sf_dir, ["path", ["o_orderstatus"], "P"]).union(_ids(spark, sf_dir, ["path", ["o_orderpriority"], "2-HIGH"])).distinct()


@register("ids_difference", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '2-HIGH'")
def ids_difference(spark, sf_dir):
    return _ids(spark, sf_dir, ["path", ["o_orderstatus"], "P"]).subtract(_ids(spark, sf_dir, ["path", ["o_orderpriority"], "2-HIGH"]))


@register("path_cardinality", "SELECT 'event_type/' || event_type AS topic, count(*) AS n FROM events GROUP BY event_type")
def path_cardinality(spark, sf_dir):
    t = load(spark, sf_dir, "events").select(F.explode(topics.of_fields({"event_type": F.col("event_type")})).alias("topic"))
    return t.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@register("embedding_policy_text", "SELECT c_custkey AS id, CASE WHEN c_mktsegment = '' THEN c_name ELSE c_name || ' / ' || c_mktsegment END AS text FROM customer")
def embedding_policy_text(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), search.policy_text(["c_name", "c_mktsegment"], " / ").alias("text"))


def _attachments(spark, sf_dir) -> DataFrame:
    p = load(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("site"), (F.col("page_id") % 10).cast("string")).alias("id"), (F.col("page_id") % 3).cast("string").alias("name"), F.sha2("html", 256).alias("digest"), F.col("page_id").alias("hlc"))


_ATTACHED = "a AS (SELECT 'site' || (page_id % 10) AS id, CAST(page_id % 3 AS VARCHAR) AS name, sha256(html) AS digest, page_id AS hlc FROM pages)"


@register("attachment_diff", f"WITH {_ATTACHED} SELECT * FROM a s WHERE NOT EXISTS (SELECT 1 FROM a t WHERE t.id = s.id AND t.name = s.name AND t.digest = s.digest AND t.hlc < 100)")
def attachment_diff(spark, sf_dir):
    a = _attachments(spark, sf_dir)
    return replication.attachment_diff(a, a.where("hlc < 100"))


@register("attachment_latest", f"WITH {_ATTACHED} SELECT id, name, max(hlc) AS hlc, arg_max(digest, hlc) AS digest FROM a GROUP BY id, name")
def attachment_latest(spark, sf_dir):
    return replication.latest_attachments(_attachments(spark, sf_dir)).select("id", "name", "hlc", "digest")


@register("attachment_get", "SELECT 'site1' AS id, '2' AS name, sha256(arg_max(html, page_id)) AS digest FROM pages WHERE page_id % 10 = 1 AND page_id % 3 = 2")
def attachment_get(spark, sf_dir):
    """The content of one attachment that was put many times."""
    p = load(spark, sf_dir, "pages")
    feed = _attachments(spark, sf_dir).join(p.select(F.col("page_id").alias("hlc"), "html"), "hlc").where("id = 'site1' AND name = '2'")
    return replication.latest_attachments(feed).select("id", "name", F.sha2("html", 256).alias("digest"))


@register("doc_update", "SELECT c_custkey AS id, c_mktsegment || '!' AS seg, 1 AS n FROM customer")
def doc_update(spark, sf_dir):
    m = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("gone"), F.col("c_name"))
    new = documents.update(documents.remove(m, "gone"), "seg", lambda v: F.concat(v, F.lit("!")))
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.try_element_at(new, F.lit("seg")).alias("seg"), documents.size(new).alias("n"))


@register("conflicts_fold", f"""WITH c AS (SELECT user_id, count(DISTINCT event_id % 2) - 1 AS n FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS id, event_id AS hlc, event_type AS body, n AS n_conflicts FROM {_LATEST} JOIN c USING (user_id)""")
def conflicts_fold(spark, sf_dir):
    """Two authors who each saw their own last write only: the older head stays as a conflict."""
    from pyspark.sql import Window

    before = F.lag("hlc").over(Window.partitionBy("id", "author").orderBy("hlc"))
    v = event_versions(spark, sf_dir).withColumn("vv", F.coalesce(F.to_json(F.when(before.isNotNull(), F.create_map("author", before))), F.lit("{}")))
    return replication.apply_versions(v).select("id", "hlc", "body", "n_conflicts")
