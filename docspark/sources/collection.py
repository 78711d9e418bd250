"""A collection: a DataFrame bound for querying by text or by condition spec.

Typed collections name one column as the id. Document collections have columns id and
body (VARIANT), and optionally deleted and expires_at (milliseconds), whose hidden rows no
query sees. Everything is lowered to one DataFrame plan.
"""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.values import Binding, ElementBinding, Value, all_of, condition, scalar_equal, sort_key
from docspark.plans import conditions
from docspark.plans.compiler import Plan, compile_query, mixed_condition, strategy
from docspark.plans.errors import QueryError

BROADCAST_HITS = 10_000
SPEC_KEYS = {"where", "select", "order_by", "limit", "offset", "id_prefix", "id_range", "include_docs", "flat", "doc_format", "decoder"}


class Collection:
    def __init__(self, df: DataFrame, id_col: str = "id", body: str | None = None, now_ms: int | None = None, search=None, overfetch: int = 3):
        if id_col not in df.columns:
            raise ValueError(f"no id column {id_col!r}")
        self.df, self.id_col, self.body, self.search = df, id_col, body, search
        self.now_ms, self.overfetch = now_ms, overfetch

    @classmethod
    def typed(cls, df: DataFrame, id_col: str, json_columns: tuple[str, ...] = (), search=None, **options) -> Collection:
        """json_columns are strings to read as documents."""
        for c in json_columns:
            df = df.withColumn(c, F.try_parse_json(F.col(c)))
        return cls(df, id_col, search=search, **options)

    @classmethod
    def documents(cls, df: DataFrame, now_ms: int | None = None, search=None, **options) -> Collection:
        return cls(df, "id", "body", now_ms, search, **options)

    @classmethod
    def from_json(cls, spark: SparkSession, docs: list[dict], **options) -> Collection:
        """Documents from Python values; top-level keys that begin with _ are not stored."""
        rows = [(str(d["id"]), json.dumps({k: v for k, v in d.items() if not k.startswith("_")})) for d in docs]
        df = spark.createDataFrame(rows, "id string, json string").select("id", F.parse_json("json").alias("body"))
        return cls.documents(df, **options)

    # scans

    def live(self) -> DataFrame:
        """Rows that are neither tombstones nor expired."""
        df = self.df
        if self.body is not None and "deleted" in df.columns:
            df = df.where(F.col("deleted").isNull() | ~F.col("deleted"))
        if self.body is not None and "expires_at" in df.columns:
            now = self.now_ms if self.now_ms is not None else int(time.time() * 1000)
            df = df.where(F.col("expires_at").isNull() | (F.col("expires_at") <= 0) | (F.col("expires_at") > now))
        return df

    def binding(self) -> Binding:
        return Binding(self.df, self.id_col, self.body)

    def get_docs(self, ids: list[str]) -> DataFrame:
        """One row per asked id, in order, NULL where there is no live document."""
        spark = self.df.sparkSession
        asked = spark.createDataFrame(list(enumerate(map(str, ids))), "pos long, asked string")
        docs = self.live()
        return asked.join(docs, F.col("asked") == F.col(f"`{self.id_col}`").cast("string"), "left").orderBy("pos").drop("pos")

    def fold(self, text: str, fn: Callable, acc, params: dict | None = None):
        """Folds rows until fn returns (acc, False); rows come one partition at a time."""
        for row in self.rows(text, params):
            acc, more = fn(acc, row)
            if not more:
                break
        return acc

    def rows(self, text: str, params: dict | None = None) -> Iterator:
        return self.query(text, params).toLocalIterator()

    # query text

    def plan(self, text: str, params: dict | None = None) -> Plan:
        return compile_query(text, params)

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        plan = compile_query(text, params)
        if plan.subscribe:
            raise QueryError("subscribe", "a SUBSCRIBE query runs through docspark.streaming.live")
        return self.run(plan)

    def subscribe(self, text: str, stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, params: dict | None = None):
        """Runs a SUBSCRIBE query over the writes in stream, from the rows of this collection: see docspark.streaming.live.subscribe."""
        from docspark.streaming import live

        return live.subscribe(self, stream, text, handler, checkpoint, params)

    def scan(self, plan: Plan) -> DataFrame:
        """The filtered base rows of a collection plan."""
        df, key = self.live(), F.col(f"`{self.id_col}`").cast("string")
        if plan.empty:
            return df.limit(0)
        if plan.id_prefix is not None:
            df = df.where(key.startswith(plan.id_prefix))
        if plan.id_range is not None:
            low, high = plan.id_range
            if low is not None and high == f"{low}\0":
                df = df.where(scalar_equal(self.binding().value(["id"]), low))
                low = high = None
            if low is not None:
                df = df.where(key >= low)
            if high is not None:
                df = df.where(key < high)
        return df.where(all_of(plan.where, self.binding())) if plan.where else df

    def run(self, plan: Plan) -> DataFrame:
        rank: list[Column] = []
        if plan.function:
            df = self._search(plan)
            rank = [F.col("__rank")]
        else:
            df = self.scan(plan)
        base = self.binding()
        element = None
        if plan.unnest:
            keys, _ = plan.unnest
            array = base.value(keys)
            items, kind = _array(array)
            df = df.select("*", F.posexplode(items).alias("__pos", "__element"))
            element = ElementBinding(Value(F.col("__element"), kind))
            for c in plan.unnest_where:
                df = df.where(mixed_condition(c, lambda x: condition(x, base), lambda x: condition(x, element, strict_lists=True)))
        if plan.order:
            var, keys, descending = plan.order
            value = self._value(base, element, var, keys)
            ties = [F.col(f"`{self.id_col}`").cast("string"), *rank, *([F.col("__pos")] if plan.unnest else [])]
            df = df.orderBy(*[k.desc() if descending else k.asc() for k in sort_key(value)], *ties)
        elif plan.limit is not None or plan.offset or rank:
            df = df.orderBy(*(rank or [F.col(f"`{self.id_col}`").cast("string")]), *([F.col("__pos")] if plan.unnest else []))
        if plan.offset:
            df = df.offset(plan.offset)
        if plan.limit is not None:
            df = df.limit(plan.limit)
        return self._project(df, plan, base, element)

    def _value(self, base: Binding, element: ElementBinding | None, var: str, keys: list) -> Value:
        if var == "unnest":
            return element.value(keys)
        if keys in (["_score"], ["_distance"]):
            return Value(F.col(keys[0]), T.DoubleType())
        return base.value(keys)

    def _project(self, df: DataFrame, plan: Plan, base: Binding, element: ElementBinding | None) -> DataFrame:
        if plan.select is None:
            if plan.unnest:
                df = df.drop("__pos").withColumnRenamed("__element", plan.unnest[1]) if plan.unnest[1] not in self.df.columns else df.drop("__pos", plan.unnest[1]).withColumnRenamed("__element", plan.unnest[1])
            return df.drop("__rank")
        out = []
        if "id" not in [n for n, _, _ in plan.select]:
            out.append(F.col(f"`{self.id_col}`").alias("id"))
        for name, var, keys in plan.select:
            if var == "base" and not keys:
                out.append((F.col(self.body) if self.body else F.struct(*[F.col(f"`{c}`") for c in self.df.columns])).alias(name))
            elif var == "base" and keys == ["id"]:
                out.append(F.col(f"`{self.id_col}`").alias(name))
            else:
                out.append(self._value(base, element, var, keys).col.alias(name))
        return df.select(*out)

    def _search(self, plan: Plan) -> DataFrame:
        """Hits joined to live documents, filtered, cut to k; the fetch is wider only where documents are filtered."""
        if self.search is None:
            raise QueryError("no_search", "the collection has no search index")
        call = plan.function
        k = call["k"]
        fetch = max(k, min(self.overfetch * k, 1000)) if plan.where else k
        hits = self.search.top(call["name"], call["query"], fetch)
        docs = self.live()
        if fetch <= BROADCAST_HITS:
            hits = F.broadcast(hits)
        df = docs.join(hits, docs[self.id_col].cast("string") == hits["__hit"]).drop("__hit")
        if plan.where:
            df = df.where(all_of(plan.where, self.binding()))
        return df.orderBy("__rank").limit(k)

    # condition specs

    def find(self, spec: dict | None = None, **options) -> DataFrame:
        """Runs a spec: where (all hold), select, order_by, limit, offset, or an id_prefix / id_range scan alone."""
        spec = {**(spec or {}), **options}
        if unknown := set(spec) - SPEC_KEYS:
            raise QueryError("invalid_spec", f"unknown spec keys {sorted(unknown)}")
        by_id = [k for k in ("id_prefix", "id_range") if k in spec]
        if by_id and spec.get("where"):
            raise QueryError("id_scan_with_where", "an id scan cannot be combined with where")
        where = [conditions.normalize(c) for c in spec.get("where", [])]
        variables = conditions.bindings(where)
        df, base, key = self.live(), self.binding(), F.col(f"`{self.id_col}`").cast("string")
        if "id_prefix" in spec:
            df = df.where(key.startswith(spec["id_prefix"]))
        if "id_range" in spec:
            low, high = spec["id_range"]
            df = df.where((key >= low if low is not None else F.lit(True)) & (key < high if high is not None else F.lit(True)))
        if where:
            df = df.where(all_of(where, base, variables))
        order = spec.get("order_by")
        limited = spec.get("limit") is not None or spec.get("offset")
        if order or limited or by_id:
            keys: list[Column] = []
            if order:
                path, direction = _order_item(order, variables)
                keys = [k.desc() if direction == "desc" else k.asc() for k in sort_key(base.value(path))]
            df = df.orderBy(*keys, key)
        if spec.get("offset"):
            df = df.offset(spec["offset"])
        if spec.get("limit") is not None:
            df = df.limit(spec["limit"])
        return self._spec_rows(df, spec, variables)

    def _spec_rows(self, df: DataFrame, spec: dict, variables: dict) -> DataFrame:
        base, select = self.binding(), spec.get("select")
        if select is None:
            doc = F.col(self.body) if self.body else F.struct(*[F.col(f"`{c}`") for c in self.df.columns])
            how = spec.get("doc_format", "map")
            if how not in ("map", "json", "binary"):
                raise QueryError("invalid_spec", f"unknown doc_format {how!r}")
            if how != "map":
                doc = F.to_json(doc)
            if how == "binary":
                doc = doc.cast("binary")
            if spec.get("decoder") is not None:
                doc = spec["decoder"](doc)
            if spec.get("flat"):
                return df
            return df.select(F.col(f"`{self.id_col}`").alias("id"), *([doc.alias("doc")] if spec.get("include_docs", True) else []))
        out = [F.col(f"`{self.id_col}`").alias("id")]
        for item in select:
            if item == "*":
                out += [base.value(p).col.alias(v) for v, p in sorted(variables.items())]
            elif isinstance(item, str) and item.startswith("?"):
                if item not in variables:
                    raise QueryError("unbound_variable", f"variable {item} is not bound")
                out.append(base.value(variables[item]).col.alias(item))
            else:
                path = conditions.check_path(item)
                if path != ["id"]:
                    out.append(base.value(path).col.alias("/".join(map(str, path))))
        return df.select(*out)

    def matches(self, cs: list) -> Column:
        """A spec's conditions as one never-NULL Column over this collection's rows."""
        return F.coalesce(self._all(cs), F.lit(False))

    def _all(self, cs: list) -> Column:
        checked = [conditions.normalize(c) for c in cs]
        return all_of(checked, self.binding(), conditions.bindings(checked))

    def page(self, spec: dict, size: int, continuation: str | None = None, ttl_ms: int | None = None) -> tuple[DataFrame, Callable[[list], str | None]]:
        """A keyset page in id order, and a function giving the next token from the page's collected ids.

        A token lasts ttl_ms; it names no version, so pages of a changing collection should come from one frame.
        """
        clock = lambda: int(time.time() * 1000)
        told = json.loads(base64.urlsafe_b64decode(continuation)) if continuation else {}
        if told.get("until") is not None and told["until"] < clock():
            raise QueryError("expired_continuation", "the page's token has expired")
        df, key = self.live(), F.col(f"`{self.id_col}`").cast("string")
        if spec.get("where"):
            df = df.where(self._all(spec["where"]))
        if told:
            df = df.where(key > told["after"])
        page = self._spec_rows(df.orderBy(key).limit(size), spec, conditions.bindings([conditions.normalize(c) for c in spec.get("where", [])]))
        return page, lambda ids: base64.urlsafe_b64encode(json.dumps({"after": str(ids[-1]), "until": None if ttl_ms is None else clock() + ttl_ms}).encode()).decode() if len(ids) == size else None

    def explain(self, query: str | dict, params: dict | None = None) -> dict:
        """Access path, conditions, variables, warnings and Spark's plan."""
        if isinstance(query, str):
            plan = compile_query(query, params)
            df = self.scan(plan) if plan.subscribe else self.run(plan)
            return {"strategy": plan.strategy(), "conditions": plan.where, "bindings": {}, "streamable": plan.streamable, "warnings": plan.warnings, "plan": df._jdf.queryExecution().toString()}
        where = [conditions.normalize(c) for c in query.get("where", [])]
        how = "id_prefix" if "id_prefix" in query else "id_range" if "id_range" in query else strategy(where)
        return {"strategy": how, "conditions": where, "bindings": conditions.bindings(where), "streamable": not query.get("order_by"), "warnings": ["full_scan"] if how == "full_scan" else [], "plan": self.find(query)._jdf.queryExecution().toString()}


def _order_item(order, variables: dict) -> tuple[list, str]:
    """The first sort key: a path, a variable, or (path, direction)."""
    first = order[0] if isinstance(order, list) and order and isinstance(order[0], (tuple, dict)) or isinstance(order, list) and order and isinstance(order[0], str) and order[0].startswith("?") else order
    direction = "asc"
    if isinstance(first, tuple) and len(first) == 2 and first[1] in ("asc", "desc"):
        first, direction = first
    if isinstance(first, str) and first.startswith("?"):
        if first not in variables:
            raise QueryError("unbound_variable", f"variable {first} is not bound")
        return variables[first], direction
    return conditions.check_path([first] if isinstance(first, str) else first), direction


def _array(v: Value) -> tuple[Column, T.DataType | None]:
    """The value as an array, NULL unless it is one, and the element type."""
    if v.variant:
        return F.try_variant_get(v.col, "$", "array<variant>"), v.kind
    if isinstance(v.kind, T.ArrayType):
        return v.col, v.kind.elementType
    return F.array().cast("array<string>"), T.StringType()
