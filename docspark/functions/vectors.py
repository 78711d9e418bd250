"""Vector arithmetic on ARRAY columns, in double precision, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "cosine_normalized", "dot", "euclidean")


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine: 1 - cos, and 1 where the norms' product is under 1e-10."""
    if metric == "cosine":
        size = norm(a) * norm(b)
        return F.when(size < 1e-10, 1.0).otherwise(1.0 - dot(a, b) / size)
    if metric == "cosine_normalized":
        return 1.0 - dot(a, b)
    if metric == "dot":
        return -dot(a, b)
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    raise ValueError(f"unknown metric {metric!r}")


def quantize_int8(v: Column) -> Column:
    """Struct of scale and bytes in -127..127: x / scale * 127 rounded, scale the largest magnitude."""
    doubles = as_doubles(v)
    scale = F.coalesce(F.array_max(F.transform(doubles, F.abs)), F.lit(0.0))

    def struct(k: Column) -> Column:
        codes = F.transform(doubles, lambda x: F.when(k == 0, F.lit(0)).otherwise(F.round(x / k * 127)).cast("tinyint"))
        return F.struct(k.alias("scale"), codes.alias("codes"))

    return F.get(F.transform(F.array(scale), struct), 0)  # the scale is computed once, not for every element


def dequantize_int8(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: c.cast("double") * q["scale"] / 127)
