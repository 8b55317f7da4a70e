"""Column functions over ``array<double>`` vectors and guarded scalars."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Floor a cost uses for log(0): twenty times the log of machine epsilon.
LOG_FLOOR = 20.0 * math.log(2.0**-52)


def as_double(col: Column | str) -> Column:
    return F.col(col).cast("array<double>") if isinstance(col, str) else col.cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``, also within its lambdas.

    A column referenced inside a lambda is otherwise inlined by the optimizer and
    evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def squared_distance(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def safe_div(num: Column, den: Column, other: float | None = 0.0) -> Column:
    """``num / den`` with a fixed answer for a zero or missing denominator."""
    ok = F.when(den != 0.0, num / den)
    return ok if other is None else F.coalesce(ok, F.lit(other))


def unit(a: Column) -> Column:
    """L2-normalise; a zero vector divides by one and stays zero."""
    return let(a, lambda x: let(norm(x), lambda n: F.transform(x, lambda v: v / F.when(n > 0.0, n).otherwise(F.lit(1.0)))))


def nan_to_zero(x: Column) -> Column:
    """NaN and both infinities become zero."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def log_or_neg_inf(x: Column) -> Column:
    return F.when(x > 0.0, F.log(F.when(x > 0.0, x))).otherwise(F.lit(float("-inf")))


def log_or_floor(x: Column) -> Column:
    return F.when(x > 0.0, F.log(F.when(x > 0.0, x))).otherwise(F.lit(LOG_FLOOR))


def binarize(a: Column, threshold: Column) -> Column:
    """``x >= threshold`` as 0/1; ties with the threshold are admitted."""
    return F.transform(a, lambda x: F.when(x >= threshold, 1).otherwise(0))


def unit_sphere(x: Column, y: Column, z: Column) -> list[Column]:
    """Project one vertex onto the unit sphere."""
    r = F.sqrt(x * x + y * y + z * z)
    return [safe_div(c, r) for c in (x, y, z)]


def icosphere_size(order: Column | int) -> Column:
    return (F.lit(10) * F.pow(F.lit(4), F.lit(order) if isinstance(order, int) else order) + 2).cast("long")


def zscored(x: Column) -> Column:
    """Demean and divide by the root sum of squares; a constant series becomes zeros."""
    centred = lambda a: let(vsum(a) / F.size(a), lambda m: F.transform(a, lambda v: v - m))
    return let(as_double(x), lambda a: unit(centred(a)))


def zscore_unit(df: DataFrame, src: str, out: str) -> DataFrame:
    return df.withColumn(out, zscored(F.col(src)))


def demean_unit_nonzero(df: DataFrame, src: str, out: str) -> DataFrame:
    """Demean and normalise rows holding any non-zero; all-zero rows pass unchanged."""
    x = as_double(src)
    return df.withColumn(out, F.when(F.exists(x, lambda v: v != 0.0), zscored(F.col(src))).otherwise(x))


def round6(x: Column) -> Column:
    """Six decimals with signed zeros folded together."""
    return F.when(F.abs(x) < 5e-7, F.lit(0.0)).otherwise(F.round(x, 6))
