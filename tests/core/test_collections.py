import itertools
import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docspark.plans.compiler import compile_query
from docspark.plans.errors import QueryError
from docspark.sources.collection import Collection

DOCS = [json.loads(x) for x in re.search(r"```json\n(.*?)```", (Path(__file__).parents[2] / "FIXTURES.md").read_text(), re.S)[1].splitlines()]


@pytest.fixture(scope="module")
def db(spark):
    c = Collection.from_json(spark, DOCS)
    c.df = c.df.cache()
    return c


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


CASES = [
    ("type = 'user' AND age > 26", "user:1 user:3"),
    ("status IN ('pending') OR org = 'acme' AND age <= 30", "user:1 user:2"),
    ("email LIKE 'alice@%'", "user:1"),
    ("email LIKE '%@_.io'", "user:1 user:2"),
    ("type = 'user' AND age IS NULL", "user:4"),
    ("age IS NOT NULL", "user:1 user:2 user:3"),
    ("type = 'user' AND email IS MISSING", "user:3 user:4"),
    ("type = 'user' AND NOT status = 'active'", "user:2 user:4"),
    ("CONTAINS(tags, 'erlang')", "post:1 post:3 user:1"),
    ("tags CONTAINS 'erlang'", "post:1 post:3 user:1"),
    ("'erlang' IN tags", "post:1 post:3 user:1"),
    ("tags = 'erlang'", "post:1 post:3 user:1"),
    ("type = 'user' AND age BETWEEN 20 AND 26", "user:2"),
    ("type = 'post' AND rank NOT BETWEEN 5 AND 9", "post:2 post:3"),
    ("address.city = 'Paris'", "user:1"),
    ("id LIKE 'post:%'", "post:1 post:2 post:3"),
    ("id >= 'user:2' AND id < 'user:4'", "user:2 user:3"),
    ("id >= 'z' AND id < 'a'", ""),
    ("id LIKE 'user:%' AND status = 'active'", "user:1 user:3"),
    ("tags[0] = 'erlang'", "post:1 user:1"),
    ("comments[1].stars = 5", "post:1"),
    ("age = 30.0", ""),
    ("age >= 30.0", "user:1 user:3"),
    ("NOT age < 30", "user:1 user:3"),
    ("name NOT IN ('Bob') AND type = 'user'", "user:1 user:3 user:4"),
]


@pytest.mark.parametrize(("where", "expected"), CASES)
def test_suite(db, where, expected):
    assert " ".join(ids(db.query(f"SELECT * FROM db WHERE {where}"))) == expected


@pytest.mark.parametrize("where", [w for w, _ in CASES if not w.startswith("id")])
def test_text_agrees_with_spec(db, where):
    plan = compile_query(f"SELECT * FROM db WHERE {where}")
    assert ids(db.find({"where": plan.where})) == ids(db.query(f"SELECT * FROM db WHERE {where}"))


def values(df, name):
    return [json.loads(r[0]) if r[0] is not None else None for r in df.select(F.to_json(name)).collect()]


def test_order(db):
    q = "SELECT name FROM db WHERE type = 'user' ORDER BY age"
    assert values(db.query(q), "name") == ["Bob", "Alice", "Carol", "Dave"]
    assert values(db.query(q + " DESC"), "name") == ["Dave", "Carol", "Alice", "Bob"]
    assert values(db.query(q + " LIMIT 2 OFFSET 1"), "name") == ["Alice", "Carol"]
    assert values(db.query(q + " OFFSET 9"), "name") == []


def test_term_order(spark):
    docs = [{"id": str(i), "v": v} for i, v in enumerate(["b", [1], {"a": 1}, True, None, False, 2.5, 1, "a"])] + [{"id": "9"}]
    got = [r["id"] for r in Collection.from_json(spark, docs).query("SELECT v FROM d ORDER BY v").collect()]
    assert got == ["7", "6", "5", "4", "9", "3", "2", "1", "8", "0"]


def test_unnest(db):
    assert sorted(values(db.query("SELECT t FROM db AS d, UNNEST(d.tags) AS t WHERE d.type = 'post'"), "t")) == ["bm25", "erlang", "erlang", "intro", "orm", "rust", "search"]
    assert values(db.query("SELECT c.author FROM db AS d, UNNEST(d.comments) AS c WHERE c.stars >= 5"), "author") == ["carol"]
    assert values(db.query("SELECT t FROM db AS d, UNNEST(d.tags) AS t ORDER BY t DESC LIMIT 2"), "t") == ["search", "rust"]


def test_projection(db):
    row = db.query("SELECT name AS who, address.city FROM db WHERE id = 'user:1'")
    assert row.columns == ["id", "who", "city"]
    assert json.loads(db.query("SELECT name, email FROM db WHERE id = 'user:3'").select(F.to_json(F.struct("*"))).first()[0]) == {"id": "user:3", "name": "Carol"}


def test_find_options(db):
    spec = {"where": [["path", ["type"], "user"], ["path", ["age"], "?A"]], "select": ["?A", ["name"]], "order_by": ("?A", "desc"), "limit": 2}
    df = db.find(spec)
    assert df.columns == ["id", "?A", "name"] and [r["id"] for r in df.collect()] == ["user:4", "user:3"]
    assert [r["id"] for r in db.find({"id_prefix": "post:"}).collect()] == ["post:1", "post:2", "post:3"]
    assert db.find({"include_docs": False}).columns == ["id"]
    assert json.loads(db.find({"where": [["path", ["rank"], 3]], "doc_format": "json"}).first()["doc"])["title"] == "Rust ORM notes"
    with pytest.raises(QueryError):
        db.find({"id_prefix": "a", "where": [["exists", ["b"]]]})
    with pytest.raises(QueryError):
        db.find({"nope": 1})
    assert ids(db.find({"where": [["not", ["path", ["status"], "active"]]]})) == ["misc:1", "post:1", "post:2", "post:3", "user:2", "user:4"]


def test_get_docs_fold_page_explain(db):
    assert [r["id"] for r in db.get_docs(["user:2", "no", "user:1"]).collect()] == ["user:2", None, "user:1"]
    assert db.fold("SELECT id FROM db ORDER BY id", lambda a, r: (a + 1, a < 2), 0) == 3
    seen, token = [], None
    while True:
        page, after = db.page({"include_docs": False}, 3, token)
        rows = [r["id"] for r in page.collect()]
        seen += rows
        token = after(rows) if rows else None
        if token is None:
            break
    assert seen == sorted(d["id"] for d in DOCS)
    e = db.explain("SELECT * FROM db WHERE type = 'user' AND age > 3")
    assert e["strategy"] == "multi_index" and e["streamable"] and not e["warnings"]
    assert db.explain("SELECT * FROM db")["warnings"] == ["full_scan"]


def test_hidden_rows(spark):
    df = spark.createDataFrame([("a", "{}", False, 0), ("b", "{}", True, 0), ("c", "{}", False, 50), ("d", "{}", None, None)], "id string, j string, deleted boolean, expires_at long")
    c = Collection.documents(df.select("id", F.parse_json("j").alias("body"), "deleted", "expires_at"), now_ms=100)
    assert ids(c.query("SELECT * FROM d")) == ["a", "d"]


def pushed(plan):
    """Filters that reach the scan, without the null checks."""
    found = re.search(r"PushedFilters: \[(.*)\], ReadSchema", plan)
    return [f for f in re.split(r", (?=[A-Z])", found[1]) if not f.startswith("IsNotNull")]


@pytest.mark.parametrize(
    ("where", "filters"),
    [
        ("s = '3'", ["EqualTo(s,3)"]),
        ("s = '3' AND x >= 2", ["EqualTo(s,3)", "GreaterThanOrEqual(x,2.0)"]),
        ("n IN (1, 2)", ["In(n, [1,2])"]),
        ("s LIKE 'ab%'", ["StringStartsWith(s,ab)"]),
        ("s = '3' OR n < 5", ["Or(EqualTo(s,3),LessThan(n,5))"]),
        ("NOT s = '3'", ["Not(EqualTo(s,3))"]),
        ("n NOT IN (1, 2)", ["Or(IsNull(n),Not(In(n, [1,2])))"]),
        ("id = '17'", ["EqualTo(k,17)"]),
    ],
)
def test_pushdown(spark, tmp_path, where, filters):
    spark.range(100).selectExpr("id AS k", "cast(id % 7 AS string) AS s", "cast(id AS double) AS x", "id % 5 AS n", "id AS other").write.parquet(str(tmp_path / "t"))
    c = Collection.typed(spark.read.parquet(str(tmp_path / "t")), "k")
    plan = c.explain(f"SELECT x FROM t WHERE {where}")["plan"]
    assert pushed(plan.split("Physical Plan")[1]) == filters
    assert "other" not in plan.split("ReadSchema")[1]


# a plain evaluator of the value rules, held against the Columns on random documents


def ev(c, d):
    kind = c[0]
    if kind == "and":
        return all(ev(x, d) for x in c[1])
    if kind == "or":
        return any(ev(x, d) for x in c[1])
    if kind == "not":
        return not ev(c[1], d)
    there, v = True, d
    for k in c[1]:
        ok = isinstance(v, dict) and k in v if isinstance(k, str) else isinstance(v, list) and 0 <= k < len(v)
        if not ok:
            there, v = False, None
            break
        v = v[k]
    same = lambda a, b: type(a) is type(b) and a == b
    if kind == "exists":
        return there
    if kind == "missing":
        return not there
    if not there:
        return False
    if kind == "path":
        return same(v, c[2]) or isinstance(v, list) and c[2] is not None and any(same(x, c[2]) for x in v)
    if kind == "in":
        return any(same(v, x) for x in c[2])
    if kind == "contains":
        return isinstance(v, list) and any(same(x, c[2]) for x in v)
    if kind == "prefix":
        return isinstance(v, str) and v.startswith(c[2])
    if kind == "regex":
        return isinstance(v, str) and re.search(c[2], v) is not None
    op, x = c[2], c[3]
    if op == "==":
        return same(v, x)
    if op == "=/=":
        return not same(v, x)
    number = lambda y: isinstance(y, (int, float)) and not isinstance(y, bool)
    if not (number(v) and number(x) or isinstance(v, str) and isinstance(x, str)):
        return False
    return {"<": v < x, "=<": v <= x, ">": v > x, ">=": v >= x}[op]


def test_fuzz_against_plain_evaluator(spark):
    r = random.Random(5)
    scalars = [None, True, False, 0, 1, 2, 1.5, 2.5, "a", "ab", "b", ""]
    value = lambda: r.choice([r.choice(scalars), [r.choice(scalars) for _ in range(r.randrange(3))], {"k": r.choice(scalars)}])
    docs = [{"id": str(i), **{f: value() for f in "xyz" if r.random() < 0.75}} for i in range(60)]
    c = Collection.from_json(spark, docs)
    c.df = c.df.cache()
    path = lambda: [r.choice("xyz"), *r.choice([[], [], ["k"], [0]])]
    lit = lambda: r.choice([s for s in scalars if s is not None])

    def leaf():
        p = path()
        return r.choice([("path", p, lit()), ("compare", p, r.choice([">", "<", ">=", "=<", "==", "=/="]), lit()), ("in", p, [lit(), lit()]), ("contains", p, lit()), ("exists", p), ("missing", p), ("prefix", p, "a"), ("regex", p, "^a.$")])

    def tree(n):
        if n == 0 or r.random() < 0.3:
            return leaf()
        return r.choice([("and", [tree(n - 1), tree(n - 1)]), ("or", [tree(n - 1), tree(n - 1)]), ("not", tree(n - 1))])

    trees = [tree(2) for _ in range(60)]
    for some in itertools.batched(trees, 20):
        rows = c.df.select("id", *[c.matches([t]).alias(f"c{i}") for i, t in enumerate(some)]).collect()
        by_id = {row["id"]: row for row in rows}
        for d in docs:
            for i, t in enumerate(some):
                assert by_id[d["id"]][f"c{i}"] == ev(t, {k: v for k, v in d.items() if k != "id"}), (t, d)


def test_typed_fuzz_against_plain_evaluator(spark):
    r = random.Random(9)
    kinds = {"s": ["a", "ab", "b", ""], "n": [0, 1, 2, -3], "x": [0.0, 1.5, 2.5], "b": [True, False]}
    lists = {"ls": "s", "ln": "n"}
    docs = [{"id": i, **{f: r.choice(v) for f, v in kinds.items() if r.random() < 0.7}, **{f: [r.choice(kinds[g]) for _ in range(r.randrange(3))] for f, g in lists.items() if r.random() < 0.7}} for i in range(50)]
    df = spark.createDataFrame([tuple(d.get(c) for c in ("id", *kinds, *lists)) for d in docs], "id long, s string, n long, x double, b boolean, ls array<string>, ln array<long>").cache()
    c = Collection.typed(df, "id")
    literals = [x for v in kinds.values() for x in v]

    def leaf():
        p = [r.choice([*kinds, *lists, "gone"])]
        if p[0] in lists and r.random() < 0.3:
            p.append(0)
        one = lambda: r.choice(literals)
        return r.choice([("path", p, one()), ("compare", p, r.choice([">", "<", ">=", "=<", "==", "=/="]), one()), ("in", p, [one(), one()]), ("contains", p, one()), ("exists", p), ("missing", p), ("prefix", p, "a"), ("regex", p, "^a.$")])

    def tree(n):
        if n == 0 or r.random() < 0.3:
            return leaf()
        return r.choice([("and", [tree(n - 1), tree(n - 1)]), ("or", [tree(n - 1), tree(n - 1)]), ("not", tree(n - 1))])

    for t in [tree(2) for _ in range(40)]:
        want = sorted(d["id"] for d in docs if ev(t, {k: v for k, v in d.items() if k != "id"}))
        assert sorted(x["id"] for x in c.find({"where": [t]}).collect()) == want, t
