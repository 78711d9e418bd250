"""The condition language under every query surface, as nested tuples, with a JSON wire form.

("path", P, V)          strict equality, or membership when the value is a list; None is null
("compare", P, op, V)   op in > < >= =< == =/= ; V may be a Var bound earlier
("and", [C]), ("or", [C]), ("not", C)
("in", P, [V]), ("contains", P, V), ("exists", P), ("missing", P)
("regex", P, pattern), ("prefix", P, string); a pattern is checked by the engine that runs it

P is a list of keys and indexes. ("path", P, Var) binds the variable to the path.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from docspark.plans.errors import QueryError

OPS = (">", "<", ">=", "=<", "==", "=/=")
MAX_DEPTH = 32


@dataclass(frozen=True)
class Var:
    name: str


def is_var(v: object) -> bool:
    return isinstance(v, Var)


def as_value(v: object) -> object:
    """Strings that begin with ? are variables in specs."""
    return Var(v) if isinstance(v, str) and v.startswith("?") and len(v) > 1 else v


def fail(reason: str, what: object):
    raise QueryError(reason, f"{reason.replace('_', ' ')}: {what!r}")


def check_path(p: object) -> list:
    if not isinstance(p, (list, tuple)) or not p or any(isinstance(k, bool) or not isinstance(k, (str, int)) for k in p) or "*" in p:
        fail("invalid_path", p)
    return list(p)


def normalize(c: object, depth: int = 0) -> tuple:
    """A checked condition, whose variables are Var objects; raises QueryError."""
    if depth > MAX_DEPTH or not isinstance(c, (list, tuple)) or not c:
        fail("invalid_condition", c)
    kind, args = c[0], list(c[1:])
    if kind in ("and", "or") and len(args) == 1 and isinstance(args[0], (list, tuple)):
        return kind, [normalize(x, depth + 1) for x in args[0]]
    if kind == "not" and len(args) == 1:
        return kind, normalize(args[0], depth + 1)
    shape = {"path": 2, "compare": 3, "in": 2, "contains": 2, "exists": 1, "missing": 1, "regex": 2, "prefix": 2}
    if shape.get(kind) != len(args):
        fail("invalid_condition", c)
    path = check_path(args[0])
    if kind == "compare":
        if args[1] not in OPS:
            fail("invalid_operator", args[1])
        return kind, path, args[1], as_value(args[2])
    if kind == "in" and not isinstance(args[1], (list, tuple)):
        fail("invalid_condition", c)
    if kind in ("regex", "prefix") and not isinstance(args[1], str):
        fail("invalid_condition", c)
    if kind == "path":
        return kind, path, as_value(args[1])
    return (kind, path, *([list(args[1])] if kind == "in" else args[1:]))


def to_json(c: tuple) -> str:
    def plain(x):
        if isinstance(x, Var):
            return x.name
        return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(plain(c))


def from_json(s: str) -> tuple:
    return normalize(json.loads(s))


def bindings(cs: list[tuple]) -> dict[str, list]:
    """Variables and their paths; a disjunction keeps what all branches bind alike."""
    out: dict[str, list] = {}
    for c in cs:
        if c[0] == "path" and is_var(c[2]):
            out.setdefault(c[2].name, c[1])
        elif c[0] == "and":
            for k, v in bindings(c[1]).items():
                out.setdefault(k, v)
        elif c[0] == "or" and c[1]:
            each = [bindings([b]) for b in c[1]]
            for k, v in each[0].items():
                if all(b.get(k) == v for b in each):
                    out.setdefault(k, v)
    return out
