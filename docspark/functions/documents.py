"""Document access and update on MAP<STRING, V> columns, and reads on VARIANT bodies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.values import variant_path


def get(body: Column, path: list, as_type: str = "variant") -> Column:
    """The value of a VARIANT body at a path; NULL where absent or of another type."""
    return F.try_variant_get(body, variant_path(path), as_type)


def is_key(body: Column, path: list) -> Column:
    return F.try_variant_get(body, variant_path(path), "variant").isNotNull()


def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def size(m: Column) -> Column:
    return F.size(F.map_keys(m))


def set_key(m: Column, key: str, value: Column) -> Column:
    return merge(m, F.create_map(F.lit(key), value))


def remove(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*names))


def take(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*names))


def update(m: Column, key: str, fn: Callable[[Column], Column]) -> Column:
    """fn applied to the value of a present key."""
    return F.transform_values(m, lambda k, v: F.when(k == key, fn(v)).otherwise(v))


def merge(a: Column, b: Column) -> Column:
    """b's values win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def map_values(m: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.transform_values(m, fn)


def filter_entries(m: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.map_filter(m, fn)


def payload_hash(text: Column) -> Column:
    return F.sha2(text, 256)
