"""Topics of documents: every leaf as field/.../value, array elements without their index."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def of_fields(fields: dict[str, Column]) -> Column:
    """Topics of flat fields; absent ones give none."""
    return F.filter(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}/"), c.cast("string"))) for k, c in fields.items()]), lambda t: t.isNotNull())


def of_json(text: str | None) -> list[str]:
    """Topics of one JSON document, sorted and distinct."""
    out: set[str] = set()

    def walk(x, at: tuple[str, ...]):
        if isinstance(x, dict):
            for k, v in x.items():
                if at or not k.startswith("_"):
                    walk(v, (*at, k))
        elif isinstance(x, list):
            for v in x:
                walk(v, at)
        else:
            out.add("/".join((*at, x if isinstance(x, str) else json.dumps(x))))

    if text:
        walk(json.loads(text), ())
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_topics(s):
    return s.map(of_json)


def pattern_regex(pattern: str) -> str:
    """An MQTT-style pattern as an anchored regex: + is one segment, a trailing # any further ones, none included."""
    segments = pattern.split("/")
    rest = segments[-1] == "#"
    body = "/".join("[^/]*" if s == "+" else re.escape(s) for s in (segments[:-1] if rest else segments))
    if rest:
        body = f"{body}(?:/.*)?" if body else ".*"
    return f"^{body}$"


def matches(topics: Column, pattern: str) -> Column:
    """Whether any topic of a row matches."""
    if "+" not in pattern and "#" not in pattern:
        return F.array_contains(topics, pattern)
    if pattern.endswith("/#") and "+" not in pattern and pattern.count("#") == 1:
        stem = pattern[:-2]
        return F.exists(topics, lambda t: (t == stem) | t.startswith(f"{stem}/"))
    return F.exists(topics, lambda t: t.rlike(pattern_regex(pattern)))


def added(old: Column, new: Column) -> Column:
    return F.array_except(new, F.coalesce(old, F.array().cast("array<string>")))


def removed(old: Column, new: Column) -> Column:
    return F.array_except(F.coalesce(old, F.array().cast("array<string>")), new)
