"""Canonical form, validation and lowering of parsed queries to a Plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from docspark.plans.ast import Between, Bool, Cmp, Lit, Not, Param, Path, Projection, Query, Test
from docspark.plans.errors import QueryError
from docspark.plans.parser import parse

TABLE_FUNCTIONS = ("vector_top_k", "bm25_top_k", "hybrid_top_k")
FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
COMPLEMENT = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
ENGINE_OP = {"<": "<", "<=": "=<", ">": ">", ">=": ">="}


def _unsupported(what: str, text: str, loc):
    raise QueryError(f"unsupported:{what}", text, loc)


@dataclass
class Plan:
    """What to run: a collection scan or a search function, then the stages in a fixed order."""

    source: str
    function: dict | None
    id_range: tuple[str | None, str | None] | None = None
    id_prefix: str | None = None
    where: list[tuple] = field(default_factory=list)
    unnest: tuple[list, str] | None = None
    unnest_where: list[tuple] = field(default_factory=list)
    order: tuple[str, list, bool] | None = None
    limit: int | None = None
    offset: int = 0
    #: None for *, else (name, var, keys)
    select: list[tuple[str, str, list]] | None = None
    alias: str = ""
    subscribe: bool = False
    empty: bool = False
    warnings: list[str] = field(default_factory=list)

    @property
    def streamable(self) -> bool:
        return self.function is None and self.order is None

    def strategy(self) -> str:
        """Name of the access path an indexed engine would choose; for explain output."""
        if self.empty:
            return "empty"
        if self.function:
            return self.function["name"]
        if self.id_range is not None:
            return "id_range"
        if self.id_prefix is not None:
            return "id_prefix"
        return strategy(self.where)


def strategy(where: list[tuple]) -> str:
    seekable = [c for c in where if c[0] == "path"]
    scannable = [c for c in where if c[0] in ("path", "compare", "prefix", "exists")]
    if len(scannable) > 1 and seekable:
        return "multi_index"
    if seekable:
        return "index_seek"
    return "index_scan" if scannable else "full_scan"


def compile_query(text: str | Query, params: dict | None = None) -> Plan:
    q = canonical(parse(text) if isinstance(text, str) else text, params or {})
    validate(q)
    return lower(q)


# canonical form


def canonical(q: Query, params: dict) -> Query:
    """Parameters filled in, aliases resolved, NOT pushed to the leaves, BETWEEN split, AND flattened."""
    alias = q.alias or (q.source.name if q.source.args is None else None)
    if q.source.args is not None and q.alias is None:
        raise QueryError("alias_required", "name the hits of a table function with AS", q.source.loc)
    path = lambda p: _resolve(p, alias, q.unnest.alias if q.unnest else None)
    value = lambda x: _bind(x, params)
    unnest = q.unnest
    if unnest:
        target = _resolve(unnest.path, alias, unnest.alias)
        if target.var == "unnest" or not target.keys:
            raise QueryError("invalid_unnest_path", "only a path inside the document can be unnested", unnest.path.loc)
        unnest = replace(unnest, path=target)
    args = q.source.args
    source = q.source if args is None else replace(q.source, args=tuple((n, value(v)) for n, v in args))
    where = [] if q.where is None else _flat(_push(q.where, False, path, value))
    select = None if q.select is None else [Projection(path(p.path), p.name, p.loc) for p in q.select]
    return replace(q, source=source, alias=alias, unnest=unnest, where=where, select=select, order=[(path(p), d) for p, d in q.order])


def _resolve(p: Path, alias: str | None, unnest: str | None) -> Path:
    head = p.keys[0]
    if unnest is not None and head == unnest:
        return replace(p, var="unnest", keys=p.keys[1:])
    if alias is not None and head == alias:
        return replace(p, var="base", keys=p.keys[1:])
    return replace(p, var="base")


def _bind(x, params: dict):
    if not isinstance(x, Param):
        return x
    if x.name not in params:
        raise QueryError("unbound_param", f"no value was given for ${x.name}", x.loc)
    v = params[x.name]
    if v is not None and not isinstance(v, (str, int, float, bool)):
        raise QueryError("invalid_param", f"${x.name} takes a string, a number, a boolean or null", x.loc)
    return Lit(x.loc, v)


def _constant(loc):
    raise QueryError("constant_predicate", "a condition compares a field with a literal; this one has no field, or two", loc)


def _push(e, negated: bool, path, value):
    if isinstance(e, Bool):
        op = {"and": "or", "or": "and"}[e.op] if negated else e.op
        return Bool(op, e.loc, _push(e.left, negated, path, value), _push(e.right, negated, path, value))
    if isinstance(e, Not):
        return _push(e.arg, not negated, path, value)
    if isinstance(e, Cmp):
        left, right = value(e.left), value(e.right)
        op = e.op
        if isinstance(left, Lit):
            left, right, op = right, left, FLIPPED[op]
        if isinstance(left, Lit):
            _constant(e.loc)
        if isinstance(right, Path):
            _unsupported("path_comparison", "unsupported: path_comparison", e.loc)
        return Cmp(e.loc, COMPLEMENT[op] if negated else op, path(left), right)
    if isinstance(e, Between):
        arg, low, high = value(e.arg), value(e.low), value(e.high)
        if isinstance(arg, Lit):
            _constant(e.loc)
        if isinstance(low, Path) or isinstance(high, Path):
            _unsupported("path_between_bound", "unsupported: path_between_bound", e.loc)
        p = path(arg)
        if e.negated != negated:
            return Bool("or", e.loc, Cmp(e.loc, "<", p, low), Cmp(e.loc, ">", p, high))
        return Bool("and", e.loc, Cmp(e.loc, ">=", p, low), Cmp(e.loc, "<=", p, high))
    arg = value(e.path)
    if isinstance(arg, Lit):
        _constant(e.loc)
    return replace(e, path=path(arg), negated=e.negated != negated)


def _flat(e) -> list:
    return _flat(e.left) + _flat(e.right) if isinstance(e, Bool) and e.op == "and" else [e]


def leaves(e) -> list:
    return leaves(e.left) + leaves(e.right) if isinstance(e, Bool) else [e]


def leaf_path(e) -> Path:
    return e.left if isinstance(e, Cmp) else e.path


# validation


def validate(q: Query) -> None:
    if q.unnest and q.unnest.alias == q.alias:
        raise QueryError("duplicate_alias", f"two sources are both called '{q.alias}'", q.unnest.loc)
    function = None
    if q.source.args is not None:
        if q.source.name not in TABLE_FUNCTIONS:
            raise QueryError("unknown_table_function", f"{q.source.name} is no table function; there are {', '.join(TABLE_FUNCTIONS)}", q.source.loc)
        function = function_args(q)
    if q.subscribe:
        _check_subscribe(q)
    paths = [p.path for p in q.select or []] + ([q.unnest.path] if q.unnest else []) + [leaf_path(x) for c in q.where for x in leaves(c)] + [p for p, _ in q.order]
    for p in paths:
        _check_path(p, function)
    for c in q.where:
        _check_conjunct(c)
    if len(q.order) > 1:
        _unsupported("multi_key_order_by", "rows are ordered by one key only", q.order[1][0].loc)
    if q.order and q.order[0][0].var == "base" and not q.order[0][0].keys:
        raise QueryError("invalid_order_key", "whole documents have no order; name a field", q.order[0][0].loc)
    seen = set()
    for p in q.select or []:
        name = output_name(p, q)
        if name in seen:
            raise QueryError("duplicate_output_name", f"two columns come out as '{name}'; rename one with AS")
        seen.add(name)


def _check_subscribe(q: Query) -> None:
    for there, what, loc in ((q.source.args is not None, "table_function", q.source.loc), (q.unnest, "unnest", q.unnest and q.unnest.loc), (q.order, "order_by", q.order and q.order[0][0].loc), (q.offset is not None, "offset", q.offset_loc)):
        if there:
            raise QueryError("unsupported_with_subscribe", f"a live query cannot have {what}", loc)


def _check_path(p: Path, function: dict | None) -> None:
    if "[*]" in p.keys:
        _unsupported("wildcard_path", "[*] is no path; unnest the array instead", p.loc)
    if p.var != "base" or not p.keys:
        return
    if p.keys == ("_score",) and function or p.keys == ("_distance",) and function and function["name"] == "vector_top_k":
        return
    if isinstance(p.keys[0], str) and p.keys[0].startswith("_"):
        raise QueryError("reserved_field", f"names such as '{p.keys[0]}' belong to the system and cannot be queried", p.loc)


def _check_conjunct(c) -> None:
    for x in leaves(c):
        p = leaf_path(x)
        values = [x.right] if isinstance(x, Cmp) else x.arg if x.__class__ is Test and x.kind == "in" else []
        if any(v.value is None for v in values):
            raise QueryError("use_is_null", "nothing equals NULL; test with IS NULL or IS MISSING", x.loc)
        if p.var == "base" and not p.keys:
            _unsupported("bare_source_reference", "a condition needs a field of the source, not the source", p.loc)
        if p.var == "base" and p.keys in (("_score",), ("_distance",)):
            _unsupported("score_in_where", "hits are not filtered by score or distance; select them or order by them", p.loc)
        if p.var == "base" and p.keys == ("id",):
            if isinstance(c, Bool):
                _unsupported("id_in_disjunction", "the id is tested on its own, never under OR or NOT", x.loc)
            fine = isinstance(x, Cmp) and x.op != "!=" and isinstance(x.right.value, str) or isinstance(x, Test) and x.kind == "like" and not x.negated and like_prefix(x.arg) is not None
            if not fine:
                _unsupported("id_condition", "an id can be equal to a string, lie in a range or begin with a prefix", x.loc)


def function_args(q: Query) -> dict:
    name, args = q.source.name, q.source.args

    def bad(what: str, loc):
        raise QueryError("invalid_table_fn_arg", what, loc)

    if not args or args[0][0] is not None or not isinstance(args[0][1].value, str):
        bad(f"{name} begins with its query, a string", q.source.loc)
    out = {"name": name, "query": args[0][1].value, "k": 10}
    seen = set()
    for option, v in args[1:]:
        if option is None:
            bad(f"{name} takes one positional argument", v.loc)
        if option in seen:
            bad(f"{option} is given to {name} twice", v.loc)
        seen.add(option)
        whole = isinstance(v.value, int) and not isinstance(v.value, bool) and v.value >= 1
        if option == "k" or option == "ef_search":
            if not whole or option == "ef_search" and name != "vector_top_k":
                bad(f"{option} of {name} is a whole number from 1 on", v.loc)
            out[option] = v.value
        else:
            bad(f"{name} has no option {option}", v.loc)
    return out


def output_name(p: Projection, q: Query) -> str:
    if p.name is not None:
        return p.name
    if not p.path.keys:
        return q.unnest.alias if p.path.var == "unnest" else q.alias
    last = p.path.keys[-1]
    if not isinstance(last, str):
        raise QueryError("alias_required", "an array element has no name of its own; give one with AS", p.path.loc)
    return last


# lowering


def like_prefix(pattern: str) -> str | None:
    """The stem of 'stem%' without other wildcards."""
    stem = pattern[:-1]
    return stem if stem and pattern.endswith("%") and "%" not in stem and "_" not in stem else None


def like_regex(pattern: str) -> str:
    body = "".join(".*" if c == "%" else "." if c == "_" else re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", c) for c in pattern)
    return f"^{body}$"


def _condition(e) -> tuple:
    if isinstance(e, Bool):
        return e.op, [_condition(e.left), _condition(e.right)]
    if isinstance(e, Cmp):
        p, v = list(e.left.keys), e.right.value
        if e.op == "=":
            return "path", p, v
        return "compare", p, "=/=" if e.op == "!=" else ENGINE_OP[e.op], v
    p = list(e.path.keys)
    if e.kind == "null":
        return ("compare", p, "=/=", None) if e.negated else ("or", [("path", p, None), ("missing", p)])
    if e.kind == "missing":
        return ("exists", p) if e.negated else ("missing", p)
    if e.kind == "in":
        inner = ("in", p, [v.value for v in e.arg])
    elif e.kind == "contains":
        inner = ("contains", p, e.arg.value)
    else:
        stem = like_prefix(e.arg)
        inner = ("prefix", p, stem) if stem is not None else ("regex", p, like_regex(e.arg))
    return ("and", [("exists", p), ("not", inner)]) if e.negated else inner


def _id_bounds(e) -> tuple[str | None, str | None]:
    """Half-open range of ids of one condition."""
    if isinstance(e, Test):
        stem = like_prefix(e.arg)
        return stem, stem + "\U0010ffff"
    v, after = e.right.value, e.right.value + "\0"
    return {"=": (v, after), ">": (after, None), ">=": (v, None), "<": (None, v), "<=": (None, after)}[e.op]


def lower(q: Query) -> Plan:
    plan = Plan(q.source.name, function_args(q) if q.source.args is not None else None, alias=q.alias or "", subscribe=q.subscribe)
    ids = []
    for c in q.where:
        own = [leaf_path(x) for x in leaves(c)]
        if any(p.var == "unnest" for p in own):
            plan.unnest_where.append(c)
        elif plan.function is None and not isinstance(c, Bool) and own[0].keys == ("id",):
            ids.append(c)
        else:
            plan.where.append(_condition(c))
    if len(ids) == 1 and isinstance(ids[0], Test):
        plan.id_prefix = like_prefix(ids[0].arg)
    elif ids:
        bounds = [_id_bounds(c) for c in ids]
        key = lambda s: s.encode("utf-8", "surrogatepass")
        low = max((b[0] for b in bounds if b[0] is not None), key=key, default=None)
        high = min((b[1] for b in bounds if b[1] is not None), key=key, default=None)
        plan.id_range = (low, high)
        plan.empty = low is not None and high is not None and key(low) >= key(high)
    if q.unnest:
        plan.unnest = (list(q.unnest.path.keys), q.unnest.alias)
        if not (plan.where or ids or plan.function):
            plan.where = [("exists", list(q.unnest.path.keys))]
    if q.order:
        p, descending = q.order[0]
        plan.order = (p.var, list(p.keys), descending)
    plan.limit, plan.offset = q.limit, q.offset or 0
    plan.empty |= q.limit == 0
    if q.select is not None:
        plan.select = [(output_name(p, q), p.path.var, list(p.path.keys)) for p in q.select]
    if plan.strategy() == "full_scan":
        plan.warnings.append("full_scan")
    return plan


def mixed_condition(c, base, unnest):
    """Condition of a conjunct over both the document and the unnested element; base and unnest compile one leaf each."""
    if isinstance(c, Bool):
        left, right = mixed_condition(c.left, base, unnest), mixed_condition(c.right, base, unnest)
        return left & right if c.op == "and" else left | right
    return (unnest if leaf_path(c).var == "unnest" else base)(_condition(c))
