"""Hybrid logical clocks, versions and version vectors as Columns.

A clock is STRUCT<wall BIGINT, logical BIGINT>, whose struct order is causal order. A
version token is 24 hex digits (wall 16, logical 8), '@' and the author. A version vector
is MAP<STRING, clock>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = "struct<wall:bigint,logical:bigint>"
VECTOR = f"map<string,{CLOCK}>"


def clock(wall: Column, logical: Column) -> Column:
    return F.struct(wall.cast("bigint").alias("wall"), logical.cast("bigint").alias("logical"))


def from_wall_time(ts: Column) -> Column:
    return clock(F.unix_millis(ts), F.lit(0))


def encode(c: Column) -> Column:
    """Lexical order of the text is the clock's order."""
    return F.lower(F.concat(F.lpad(F.hex(c["wall"]), 16, "0"), F.lpad(F.hex(c["logical"]), 8, "0")))


def decode(s: Column) -> Column:
    return clock(F.conv(F.substring(s, 1, 16), 16, 10).cast("bigint"), F.conv(F.substring(s, 17, 8), 16, 10).cast("bigint"))


def token(c: Column, author: Column) -> Column:
    return F.concat(encode(c), F.lit("@"), F.lower(F.hex(author)))


def token_clock(t: Column) -> Column:
    return decode(F.substring_index(t, "@", 1))


def token_author(t: Column) -> Column:
    return F.decode(F.unhex(F.substring_index(t, "@", -1)), "UTF-8")


def newest(a: Column, b: Column) -> Column:
    """The later of two version tokens: clock first, then author."""
    return F.greatest(a, b)


def contains(vv: Column, author: Column, c: Column) -> Column:
    """Whether the vector covers a version."""
    return F.coalesce(F.try_element_at(vv, author) >= c, F.lit(False))


def bump(vv: Column, author: Column, c: Column) -> Column:
    return merge(vv, F.create_map(author, c))


def merge(a: Column, b: Column) -> Column:
    """Pointwise maximum."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def compare(a: Column, b: Column) -> Column:
    """eq, dominates, dominated or concurrent."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.struct(x.alias("x"), y.alias("y")))
    more = F.exists(F.map_values(both), lambda p: p["y"].isNull() | F.coalesce(p["x"] > p["y"], F.lit(False)))
    less = F.exists(F.map_values(both), lambda p: p["x"].isNull() | F.coalesce(p["y"] > p["x"], F.lit(False)))
    return F.when(more & less, "concurrent").when(more, "dominates").when(less, "dominated").otherwise("eq")
