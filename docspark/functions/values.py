"""Value semantics of the query language as Columns: the only place that knows them.

A Binding resolves paths. For typed frames SQL NULL is a missing value and types are
settled while binding; for document frames the body is VARIANT and every test carries its
type check.

Conditions are two-valued. Leaves are bare predicates, whose NULL means false, so that
sources can take them as filters; NOT turns the NULL of what it negates into false first,
as do uses of a condition outside of filters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.plans.conditions import Var
from docspark.plans.errors import QueryError

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTION = (T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass
class Value:
    """A resolved path: its column and type; kind is None for an absent path."""

    col: Column
    kind: T.DataType | None
    whole: Column | None = None  # the integer column behind an id that reads as text

    @property
    def variant(self) -> bool:
        return isinstance(self.kind, T.VariantType)


def absent() -> Value:
    return Value(F.lit(None).cast("string"), None)


def variant_path(keys: list) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" if "'" not in k else f'["{k}"]' for k in keys)


def descend(v: Value, keys: list) -> Value:
    for i, k in enumerate(keys):
        if v.kind is None:
            return absent()
        if v.variant:
            return Value(F.try_variant_get(v.col, variant_path(keys[i:]), "variant"), v.kind)
        if isinstance(v.kind, T.StructType) and isinstance(k, str) and k in v.kind.names:
            v = Value(v.col.getField(k), v.kind[k].dataType)
        elif isinstance(v.kind, T.ArrayType) and isinstance(k, int):
            v = Value(F.get(v.col, k), v.kind.elementType)
        elif isinstance(v.kind, T.MapType) and isinstance(k, str):
            v = Value(F.try_element_at(v.col, F.lit(k)), v.kind.valueType)
        else:
            return absent()
    return v


class Binding:
    """Paths of one frame. body: the VARIANT column of a document frame, or None for a typed one."""

    def __init__(self, df: DataFrame, id_col: str = "id", body: str | None = None):
        self.schema, self.id_col, self.body = df.schema, id_col, body

    def value(self, keys: list) -> Value:
        if not keys:
            raise QueryError("bare_source_reference", "a path needs a field")
        if keys == ["id"]:
            c = F.col(f"`{self.id_col}`")
            return Value(c.cast("string"), T.StringType(), c if isinstance(self.schema[self.id_col].dataType, WHOLE) else None)
        if self.body is not None:
            return descend(Value(F.col(f"`{self.body}`"), T.VariantType()), list(keys))
        if keys[0] not in self.schema.names:
            return absent()
        return descend(Value(F.col(f"`{keys[0]}`"), self.schema[keys[0]].dataType), list(keys[1:]))


class ElementBinding:
    """Paths below an unnested element."""

    def __init__(self, element: Value):
        self.element = element

    def value(self, keys: list) -> Value:
        return descend(self.element, list(keys))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def kind_of(v: Value) -> Column:
    """Schema text of a variant; NULL when absent."""
    return F.schema_of_variant(v.col)


def _is_fraction(kind: Column) -> Column:
    return kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _get(v: Value, as_type: str) -> Column:
    return F.try_variant_get(v.col, "$", as_type)


def exists(v: Value) -> Column:
    return F.lit(False) if v.kind is None else v.col.isNotNull()


def fitting(v: Value, x: object) -> Column | None:
    """The literal as the typed value's kind compares with it, None where the two are never equal."""
    if v.kind is None or x is None:
        return None
    if isinstance(x, bool):
        return F.lit(x) if isinstance(v.kind, T.BooleanType) else None
    if isinstance(x, int):
        return F.lit(x) if isinstance(v.kind, WHOLE) else None
    if isinstance(x, float):
        return F.lit(x) if isinstance(v.kind, FRACTION) else None
    if isinstance(v.kind, TIMES):
        return F.lit(x).try_cast(v.kind)
    return F.lit(x) if isinstance(v.kind, T.StringType) else None


def _whole_id(x: object) -> int | None:
    """The integer that a text names, if it is the one an id of that value reads as."""
    return int(x) if isinstance(x, str) and re.fullmatch(r"0|-?[1-9][0-9]{0,17}", x) else None


def scalar_equal(v: Value, x: object) -> Column:
    """Strict equality: no coercion between integers, fractions, strings and booleans."""
    if v.kind is None:
        return F.lit(False)
    if v.variant:
        kind = kind_of(v)
        if x is None:
            return F.is_variant_null(v.col)
        if isinstance(x, bool):
            return (_get(v, "boolean") == x) & (kind == "BOOLEAN")  # the type is looked at only where the value fits
        if isinstance(x, int):
            return (_get(v, "bigint") == x) & (kind == "BIGINT")
        if isinstance(x, float):
            return (_get(v, "double") == x) & _is_fraction(kind)
        return (_get(v, "string") == x) & (kind == "STRING")
    if v.whole is not None and _whole_id(x) is not None:
        return v.whole == _whole_id(x)
    want = fitting(v, x)
    return F.lit(False) if want is None else v.col == want


def any_equal(v: Value, xs: list) -> Column:
    """Whether the value equals one of the literals."""
    if not v.variant and v.whole is None and len(xs) > 1 and not isinstance(v.kind, TIMES):
        wanted = [w for w in (fitting(v, x) for x in xs) if w is not None]
        return v.col.isin(*wanted) if wanted else F.lit(False)
    out = F.lit(False)
    for x in xs:
        out = out | scalar_equal(v, x)
    return out


def has_element(v: Value, x: object) -> Column:
    """Whether the value is a list holding x."""
    if v.variant:
        return F.exists(_get(v, "array<variant>"), lambda e: _true(scalar_equal(Value(e, v.kind), x)))
    if isinstance(v.kind, T.ArrayType):
        return F.exists(v.col, lambda e: _true(scalar_equal(Value(e, v.kind.elementType), x)))
    return F.lit(False)


def compare(v: Value, op: str, x: object) -> Column:
    """Order holds between numbers and between strings; =/= holds for any present value that is not equal."""
    if op == "==":
        return scalar_equal(v, x)
    if op == "=/=":
        if v.variant or v.whole is not None:
            return exists(v) & ~_true(scalar_equal(v, x))
        want = fitting(v, x)
        return exists(v) if want is None else v.col != want if not isinstance(v.kind, TIMES) else exists(v) & ~_true(v.col == want)
    if v.kind is None or x is None or isinstance(x, bool):
        return F.lit(False)
    number = not isinstance(x, str)
    if v.variant:
        kind = kind_of(v)
        if number:
            fits, c = (kind == "BIGINT") | _is_fraction(kind), _get(v, "double")
            if isinstance(x, int) and abs(x) >= 1 << 53:
                c = _get(v, "decimal(38,0)")
        else:
            fits, c = kind == "STRING", _get(v, "string")
        return _ordered(c, op, F.lit(x)) & fits
    if number:
        return _ordered(v.col, op, F.lit(x)) if isinstance(v.kind, (*WHOLE, *FRACTION)) else F.lit(False)
    if isinstance(v.kind, TIMES):
        return _ordered(v.col, op, F.lit(x).try_cast(v.kind))
    return _ordered(v.col, op, F.lit(x)) if isinstance(v.kind, T.StringType) else F.lit(False)


def _ordered(a: Column, op: str, b: Column) -> Column:
    return a < b if op == "<" else a <= b if op == "=<" else a > b if op == ">" else a >= b


def text_of(v: Value) -> Column | None:
    """The value as text where it is a string, NULL elsewhere."""
    if v.kind is None:
        return None
    if v.variant:
        return F.when(kind_of(v) == "STRING", _get(v, "string"))
    return v.col if isinstance(v.kind, T.StringType) else None


def number_of(v: Value) -> Column:
    """The value as a double where it is a number, NULL elsewhere."""
    if v.variant:
        return F.when((kind_of(v) == "BIGINT") | _is_fraction(kind_of(v)), _get(v, "double"))
    return v.col.cast("double") if isinstance(v.kind, (*WHOLE, *FRACTION)) else F.lit(None).cast("double")


def compare_values(a: Value, op: str, b: Value) -> Column:
    """A comparison of two paths, by the same rules."""
    if a.kind is None or b.kind is None:
        return F.lit(False)
    if a.variant or b.variant:
        left_n, right_n = number_of(a), number_of(b)
        left_s, right_s = (x if (x := text_of(v)) is not None else F.lit(None).cast("string") for v in (a, b))
        same = _true(left_n == right_n) | _true(left_s == right_s)
        if op in ("==", "=/="):
            return same if op == "==" else exists(a) & exists(b) & ~same
        return _true(_ordered(left_n, op, right_n)) | _true(_ordered(left_s, op, right_s))
    numbers = isinstance(a.kind, (*WHOLE, *FRACTION)) and isinstance(b.kind, (*WHOLE, *FRACTION))
    alike = numbers or type(a.kind) is type(b.kind)
    if op == "==":
        strict = isinstance(a.kind, WHOLE) == isinstance(b.kind, WHOLE) if numbers else alike
        return _true(a.col == b.col) if strict else F.lit(False)
    if op == "=/=":
        strict = isinstance(a.kind, WHOLE) == isinstance(b.kind, WHOLE) if numbers else alike
        return exists(a) & exists(b) & ((a.col != b.col) if strict else F.lit(True))
    return _true(_ordered(a.col, op, b.col)) if alike and not isinstance(a.kind, T.BooleanType) else F.lit(False)


def java_regex(pattern: str) -> str:
    """The pattern, if the engine that will run it takes it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None and hasattr(spark, "_jvm"):
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:
            raise QueryError("invalid_regex", f"invalid regex: {pattern!r}") from e
    return pattern


def _plain(c: tuple, binding) -> Value | None:
    """The value a leaf tests, where it is a typed scalar and the leaf is NULL only if the value is."""
    if c[0] not in ("path", "compare", "in", "prefix", "regex") or any(isinstance(x, Var) for x in c[2:]):
        return None
    v = binding.value(list(c[1]))
    scalar = isinstance(v.kind, (*WHOLE, *FRACTION, T.StringType, T.BooleanType))
    return v if scalar and not (c[0] == "compare" and c[2] == "=/=") else None


def condition(c: tuple, binding, variables: dict[str, list] | None = None, strict_lists: bool = False) -> Column:
    """A checked condition as a boolean Column, whose NULL means false."""
    kind = c[0]
    if kind in ("and", "or"):
        out = F.lit(kind == "and")
        for x in c[1]:
            one = condition(x, binding, variables, strict_lists)
            out = out & one if kind == "and" else out | one
        return out
    if kind == "not":
        inner = condition(c[1], binding, variables, strict_lists)
        if (v := _plain(c[1], binding)) is not None:
            return (v.col if v.whole is None else v.whole).isNull() | ~inner
        return ~_true(inner)
    v = binding.value(list(c[1]))
    if kind == "path":
        if isinstance(c[2], Var):
            return exists(v)
        equal = scalar_equal(v, c[2])
        return equal if strict_lists or c[2] is None else equal | has_element(v, c[2])
    if kind == "compare":
        if isinstance(c[3], Var):
            if not variables or c[3].name not in variables:
                raise QueryError("unbound_variable", f"variable {c[3].name} is not bound by an earlier condition")
            return compare_values(v, c[2], binding.value(variables[c[3].name]))
        return compare(v, c[2], c[3])
    if kind == "in":
        return any_equal(v, c[2])
    if kind == "contains":
        return has_element(v, c[2])
    if kind == "exists":
        return exists(v)
    if kind == "missing":
        return ~exists(v)
    text = text_of(v)
    if text is None:
        return F.lit(False)
    return text.rlike(java_regex(c[2])) if kind == "regex" else text.startswith(c[2])


def all_of(cs: list[tuple], binding, variables: dict[str, list] | None = None, strict_lists: bool = False) -> Column:
    """All conditions, for a filter."""
    return condition(("and", cs), binding, variables, strict_lists)


def sort_key(v: Value) -> list[Column]:
    """Term order: numbers, false, null and missing, true, objects, arrays, strings by bytes."""
    if v.kind is None:
        return [F.lit(2)]
    if not v.variant:
        if isinstance(v.kind, T.BooleanType):
            return [F.when(v.col.isNull(), 2).when(v.col, 3).otherwise(1)]
        if isinstance(v.kind, (T.StructType, T.MapType, T.ArrayType)):
            return [F.when(v.col.isNull(), 2).otherwise(5 if isinstance(v.kind, T.ArrayType) else 4), F.to_json(v.col)]
        rank = 0 if isinstance(v.kind, (*WHOLE, *FRACTION, *TIMES)) else 6
        return [F.when(v.col.isNull(), 2).otherwise(rank), v.col]
    kind = kind_of(v)
    number = (kind == "BIGINT") | _is_fraction(kind)
    rank = F.when(kind.isNull() | (kind == "VOID"), 2).when(number, 0).when(kind == "BOOLEAN", F.when(_get(v, "boolean"), 3).otherwise(1)).when(kind.startswith("OBJECT"), 4).when(kind.startswith("ARRAY"), 5).otherwise(6)
    text = F.when(kind == "STRING", _get(v, "string")).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(v.col))
    return [rank, F.when(number, _get(v, "double")), text]
