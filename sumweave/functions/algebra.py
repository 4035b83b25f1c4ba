"""Partial aggregates, how multiplicities weigh them, and how they are finished.

For a join on a key, rows are replaced by summaries: n rows, sum s and count c of an argument, its least and greatest value. In a join a
summary is repeated as often as the other sides have rows: n, s and c are multiplied by the others' n; min and max are not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUNCTIONS = ("count_star", "count", "sum", "avg", "min", "max")
#: Parts that a function needs of its argument.
PARTS = {"count_star": (), "count": ("c",), "sum": ("s",), "avg": ("s", "c"), "min": ("m",), "max": ("m",)}
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
WIDE = "decimal(38,0)"


def supported(fn: str, kind: T.DataType) -> str | None:
    """Why a function over an argument of this type isn't rewritten, or None."""
    if fn not in FUNCTIONS:
        return f"aggregate {fn} has no summary by key"
    if fn in ("sum", "avg"):
        if isinstance(kind, T.DecimalType) and kind.precision > 15:
            return "weighted sums of this decimal type may not fit 38 digits"
        if not isinstance(kind, (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)):
            return f"{fn} of {kind.simpleString()}"
    if fn in ("min", "max") and isinstance(kind, (T.MapType, T.VariantType)):
        return f"{fn} of {kind.simpleString()}"
    return None


def collation_ok(kind: T.DataType) -> bool:
    return not isinstance(kind, T.StringType) or kind.simpleString() == "string"


def product(factors: list[Column]) -> Column | None:
    """Product of multiplicities; None stands for 1."""
    out = None
    for f in factors:
        out = f if out is None else out * f
    return out


def held(n: Column) -> Column:
    """A wide count; more than 38 digits are an error, also where Spark would make them null."""
    return F.coalesce(n, F.raise_error(F.lit("more rows than 38 digits can count")).cast(WIDE))


def wide_total(n: Column) -> Column:
    """The sum of wide counts, null of no rows."""
    return F.coalesce(F.sum(n), F.when(F.count(F.lit(1)) > 0, held(F.lit(None).cast(WIDE))))


def narrow(n: Column) -> Column:
    """A wide count as BIGINT; a number that doesn't fit is an error, never another number."""
    return F.when(n <= F.lit(2**63 - 1), n.cast("bigint")).otherwise(F.raise_error(F.concat(n.cast("string"), F.lit(" rows are more than a BIGINT can count"))).cast("bigint"))


def weighted(value: Column, kind: T.DataType, weight: Column | None) -> Column:
    """value * weight, exact for integral types: longs are multiplied as decimals and brought back after summing."""
    if weight is None:
        return value
    if isinstance(kind, _INTEGRAL):
        return value.cast("decimal(19,0)") * weight.cast("decimal(19,0)")
    if isinstance(kind, T.DecimalType):  # exact: the digits of both and one more are at most 38
        digits = min(20, 37 - min(38, kind.precision + 10))
        fits = F.when(weight < F.lit(f"1{'0' * digits}").cast("decimal(38,0)"), weight) if digits < 19 else weight
        return value * (F.coalesce(fits, F.raise_error(F.lit("a join multiplies more rows than a decimal sum can count")).cast("bigint")) if digits < 19 else fits).cast(f"decimal({digits},0)")
    return value.cast("double") * weight  # a FLOAT argument is summed as double, as in the direct plan


def sum_type(kind: T.DataType) -> str:
    if isinstance(kind, _INTEGRAL):
        return "bigint"
    if isinstance(kind, T.DecimalType):
        return f"decimal({min(38, kind.precision + 10)},{kind.scale})"
    return "double"


def own_parts(fn: str, arg: Column | None, kind: T.DataType | None, weight: Column | None) -> dict[str, Column]:
    """Aggregate expressions for the parts of an argument that belongs to the relation at hand."""
    out: dict[str, Column] = {}
    for part in PARTS[fn]:
        if part == "c":
            out[part] = F.count(arg) if weight is None else F.sum(F.when(arg.isNotNull(), weight).otherwise(F.lit(0).cast("bigint")))
        elif part == "s":
            out[part] = F.sum(weighted(arg, kind, weight)).cast(sum_type(kind))
        else:
            out[part] = F.min(arg) if fn == "min" else F.max(arg)
    return out


def inherited_parts(fn: str, parts: dict[str, Column], kind: T.DataType | None, weight: Column | None) -> dict[str, Column]:
    """The same for parts that come with a summary; weight: the multiplicity of all that the summary isn't part of."""
    out: dict[str, Column] = {}
    for part, x in parts.items():
        if part == "c":
            out[part] = F.sum(x if weight is None else x * weight)
        elif part == "s":
            total = T.LongType() if isinstance(kind, _INTEGRAL) else kind
            out[part] = F.sum(weighted(x, total, weight)).cast(sum_type(kind))
        else:
            out[part] = F.min(x) if fn == "min" else F.max(x)
    return out


def single_parts(fn: str, parts: dict[str, Column], kind: T.DataType | None, weight: Column | None) -> dict[str, Column]:
    """The same as inherited_parts where every group is one row: weights are applied, nothing is added up."""
    out: dict[str, Column] = {}
    for part, x in parts.items():
        if part == "c":
            out[part] = x if weight is None else x * weight
        elif part == "s":
            total = T.LongType() if isinstance(kind, _INTEGRAL) else kind
            out[part] = weighted(x, total, weight).cast(sum_type(kind))
        else:
            out[part] = x
    return out


def finish(fn: str, parts: dict[str, Column], n: Column, grouped: bool, kind: T.DataType | None = None) -> Column:
    """The result of a function over an argument of a type from its summed parts; counts of no rows are 0, all else of no rows is null."""
    if fn == "count_star":
        return n if grouped else F.coalesce(n, F.lit(0).cast("bigint"))
    if fn == "count":
        return parts["c"] if grouped else F.coalesce(parts["c"], F.lit(0).cast("bigint"))
    if fn == "avg" and isinstance(kind, T.DecimalType):
        return F.try_divide(parts["s"], parts["c"].cast("decimal(20,0)")).cast(f"decimal({min(38, kind.precision + 4)},{min(38, kind.scale + 4)})")
    if fn == "avg":
        return F.try_divide(parts["s"].cast("double"), parts["c"].cast("double"))
    return parts["s"] if fn == "sum" else parts["m"]
