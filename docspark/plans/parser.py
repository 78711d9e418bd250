"""Tokenizer and recursive-descent parser of the query language."""

from __future__ import annotations

import re

from docspark.plans.ast import Between, Bool, Cmp, Lit, Not, Param, Path, Projection, Query, Source, Test, Unnest
from docspark.plans.errors import syntax

KEYWORDS = frozenset("SELECT FROM WHERE ORDER BY LIMIT OFFSET AS UNNEST ASC DESC AND OR NOT IN LIKE BETWEEN IS NULL MISSING TRUE FALSE SUBSCRIBE CONTAINS".split())
TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)|(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?)|(?P<int>\d+)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<param>\$[A-Za-z_][A-Za-z0-9_]*)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>=>|!=|<>|<=|>=|[=<>(),.*\[\]-])"""
)
COMPARISONS = ("=", "!=", "<>", "<", "<=", ">", ">=")


def tokens(text: str) -> list[tuple[str, object, tuple[int, int]]]:
    """(kind, value, (line, column)); kinds: kw, ident, str, int, float, param, op, end."""
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        m = TOKEN.match(text, at)
        loc = (line, at - start + 1)
        if m is None:
            raise syntax(f"illegal character {text[at]!r}", loc)
        kind, s = m.lastgroup, m.group()
        if kind == "word":
            out.append(("kw", s.upper(), loc) if s.upper() in KEYWORDS else ("ident", s, loc))
        elif kind in ("string", "quoted"):
            q = s[0]
            out.append(("str" if kind == "string" else "ident", s[1:-1].replace(q + q, q), loc))
        elif kind == "int":
            out.append(("int", int(s), loc))
        elif kind == "float":
            out.append(("float", float(s), loc))
        elif kind == "param":
            out.append(("param", s[1:], loc))
        elif kind == "op":
            out.append(("op", s, loc))
        breaks = s.count("\n")
        if breaks:
            line, start = line + breaks, at + s.rindex("\n") + 1
        at = m.end()
    out.append(("end", None, (line, at - start + 1)))
    return out


class _Parser:
    def __init__(self, text: str):
        self.toks, self.i = tokens(text), 0

    @property
    def tok(self):
        return self.toks[self.i]

    @property
    def loc(self):
        return self.tok[2]

    def at(self, *values: str) -> bool:
        return self.tok[0] in ("kw", "op") and self.tok[1] in values

    def take(self, *values: str) -> bool:
        if self.at(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str):
        if not self.take(value):
            self.fail()

    def fail(self):
        kind, value, loc = self.tok
        raise syntax("unexpected end of query" if kind == "end" else f"unexpected {value!r}", loc)

    def ident(self) -> str:
        if self.tok[0] != "ident":
            self.fail()
        self.i += 1
        return self.toks[self.i - 1][1]

    def integer(self) -> int:
        if self.tok[0] != "int":
            self.fail()
        self.i += 1
        return self.toks[self.i - 1][1]

    def query(self) -> Query:
        self.need("SELECT")
        select = None if self.take("*") else self.listed(self.projection)
        self.need("FROM")
        source = self.source()
        alias = self.ident() if self.take("AS") or self.tok[0] == "ident" else None
        unnest = None
        if self.take(","):
            loc = self.loc
            self.need("UNNEST")
            self.need("(")
            path = self.path()
            self.need(")")
            self.need("AS")
            unnest = Unnest(path, self.ident(), loc)
        q = Query(select, source, alias, unnest, self.expr() if self.take("WHERE") else None)
        if self.take("ORDER"):
            self.need("BY")
            q.order = self.listed(self.order_item)
        if self.take("LIMIT"):
            q.limit = self.integer()
        if self.take("OFFSET"):
            q.offset_loc = self.loc
            q.offset = self.integer()
        q.subscribe = self.take("SUBSCRIBE")
        if self.tok[0] != "end":
            self.fail()
        return q

    def listed(self, item):
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    def projection(self) -> Projection:
        path = self.path()
        return Projection(path, self.ident() if self.take("AS") else None, path.loc)

    def order_item(self):
        path = self.path()
        return path, self.take("DESC") or (self.take("ASC") and False)

    def source(self) -> Source:
        loc = self.loc
        name = self.ident()
        if not self.take("("):
            return Source(name, loc)
        args = self.listed(self.argument)
        self.need(")")
        return Source(name, loc, tuple(args))

    def argument(self):
        name = None
        if self.tok[0] == "ident":
            name = self.ident()
            self.need("=>")
        return name, self.param() if self.tok[0] == "param" else self.literal()

    def path(self) -> Path:
        loc = self.loc
        keys: list[str | int] = [self.ident()]
        while self.at(".", "["):
            if self.take("."):
                if self.tok[0] not in ("ident", "kw"):
                    self.fail()
                keys.append(self.tok[1] if self.tok[0] == "ident" else self.tok[1].lower())
                self.i += 1
            else:
                self.need("[")
                keys.append("[*]" if self.take("*") else self.integer())
                self.need("]")
        return Path(loc, tuple(keys))

    def param(self) -> Param:
        self.i += 1
        return Param(self.toks[self.i - 1][2], self.toks[self.i - 1][1])

    def is_literal(self) -> bool:
        return self.tok[0] in ("str", "int", "float") or self.at("-", "TRUE", "FALSE", "NULL")

    def literal(self) -> Lit:
        kind, value, loc = self.tok
        if kind in ("str", "int", "float"):
            self.i += 1
            return Lit(loc, value)
        if self.take("-"):
            if self.tok[0] not in ("int", "float"):
                self.fail()
            self.i += 1
            number = self.toks[self.i - 1]
            return Lit(number[2], -number[1])
        for word, v in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return Lit(loc, v)
        self.fail()

    def operand(self):
        if self.tok[0] == "ident":
            return self.path()
        return self.param() if self.tok[0] == "param" else self.literal()

    def expr(self):
        left = self.conjunction()
        while self.at("OR"):
            loc = self.loc
            self.i += 1
            left = Bool("or", loc, left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.at("AND"):
            loc = self.loc
            self.i += 1
            left = Bool("and", loc, left, self.negation())
        return left

    def negation(self):
        loc = self.loc
        return Not(loc, self.negation()) if self.take("NOT") else self.predicate()

    def predicate(self):
        loc = self.loc
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        if self.take("CONTAINS"):
            self.need("(")
            path = self.path()
            self.need(",")
            arg = self.literal()
            self.need(")")
            return Test("contains", loc, path, arg)
        left = self.operand()
        loc = self.loc
        if self.at(*COMPARISONS):
            op = self.tok[1]
            self.i += 1
            return Cmp(loc, "!=" if op == "<>" else op, left, self.operand())
        if self.take("IS"):
            negated = self.take("NOT")
            if self.take("NULL"):
                return Test("null", loc, left, negated=negated)
            self.need("MISSING")
            return Test("missing", loc, left, negated=negated)
        if isinstance(left, Path) and self.take("CONTAINS"):
            return Test("contains", loc, left, self.literal())
        negated = self.take("NOT")
        loc = self.loc
        if self.take("IN"):
            if self.take("("):
                values = self.listed(self.literal)
                self.need(")")
                return Test("in", loc, left, tuple(values), negated)
            path = self.path()
            if not isinstance(left, Lit):
                raise syntax("IN a path needs a literal on its left", loc)
            inner = Test("contains", loc, path, left)
            return Not(loc, inner) if negated else inner
        if self.take("LIKE"):
            if self.tok[0] != "str":
                self.fail()
            return Test("like", loc, left, self.literal().value, negated)
        if self.take("BETWEEN"):
            low = self.operand()
            self.need("AND")
            return Between(loc, left, low, self.operand(), negated)
        self.fail()


def parse(text: str) -> Query:
    return _Parser(text).query()
