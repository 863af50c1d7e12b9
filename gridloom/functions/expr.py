"""Column expressions with NumPy's semantics where Spark's differ: NaN comparisons, closeness, grids, differences.

Spark orders NaN above every number and equal to itself; here a comparison with NaN is false. Divisions that may meet
zero are guarded, because ANSI mode raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def is_finite(x) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(INF))


def above(x, y) -> Column:
    """x > y, false for NaN on either side."""
    return (col(x) > col(y)) & ~F.isnan(col(x)) & ~F.isnan(col(y))


def below(x, y) -> Column:
    return above(y, x)


def isclose(x, y, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|x - y| <= atol + rtol * |y|; the tolerance follows the second argument, and NaN is close to nothing."""
    x, y = col(x).cast("double"), col(y).cast("double")
    gap = F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)
    return (x == y) & ~F.isnan(x) | gap & is_finite(x) & is_finite(y)


def allclose(xs, ys, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether two arrays have one length and close elements."""
    xs, ys = col(xs), col(ys)
    return (F.size(xs) == F.size(ys)) & F.forall(F.zip_with(xs, ys, lambda x, y: isclose(x, y, rtol, atol)), lambda ok: ok)


def divide(x, y, if_zero: float | None = None) -> Column:
    """x / y, and if_zero (null by default) where y is zero."""
    return F.when(col(y) == 0, F.lit(if_zero).cast("double")).otherwise(col(x) / col(y))


def standardize(x, offset, scale) -> Column:
    return (col(x) - col(offset)) / col(scale)


def unstandardize(x, offset, scale) -> Column:
    return col(x) * col(scale) + col(offset)


def positive_or_one(x) -> Column:
    return F.when(above(x, 0.0), col(x)).otherwise(F.lit(1.0))


def linspace(low, high, cells) -> Column:
    """The cells + 1 faces of an evenly divided interval; the last is exactly high."""
    low, high, cells = col(low).cast("double"), col(high).cast("double"), col(cells).cast("int")
    return F.transform(F.sequence(F.lit(0), cells), lambda i: F.when(i == cells, high).otherwise(low + i * ((high - low) / cells)))


def tail(xs: Column) -> Column:
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0)))


def init(xs: Column) -> Column:
    return F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0)))


def midpoints(xs) -> Column:
    """Means of neighbours: centres from faces, cell values from face values."""
    xs = col(xs)
    return F.zip_with(init(xs), tail(xs), lambda a, b: F.lit(0.5) * (a + b))


def differences(xs) -> Column:
    xs = col(xs)
    return F.zip_with(init(xs), tail(xs), lambda a, b: b - a)


def uniform_spacing(xs) -> Column:
    """The first spacing of evenly spaced coordinates (relative tolerance 1e-6); an error otherwise."""
    steps = differences(xs)
    first = F.element_at(steps, 1)
    even = F.forall(steps, lambda s: F.abs(s - first) <= F.lit(1e-6) * F.abs(first))
    return F.when(F.size(col(xs)) < 2, F.raise_error(F.lit("spacing needs at least two points")).cast("double")).when(even, first).otherwise(F.raise_error(F.lit("the grid is not evenly spaced")).cast("double"))


def central(before, here, after, step_before, step_after) -> Column:
    """The second-order derivative from unevenly spaced neighbours."""
    p, q = step_before, step_after
    return -q / (p * (p + q)) * before + (q - p) / (p * q) * here + p / (q * (p + q)) * after


def gradient(values, coords) -> Column:
    """Derivative along an array: second order inside, one-sided at both ends (two points at least)."""
    values, coords = col(values), col(coords)
    n = F.size(values)
    v, x = (lambda i: F.get(values, i)), (lambda i: F.get(coords, i))

    def at(_, i):
        inside = central(v(i - 1), v(i), v(i + 1), x(i) - x(i - 1), x(i + 1) - x(i))
        first = (v(F.lit(1)) - v(F.lit(0))) / (x(F.lit(1)) - x(F.lit(0)))
        last = (v(i) - v(i - 1)) / (x(i) - x(i - 1))
        return F.when(i == 0, first).when(i == n - 1, last).otherwise(inside)

    return F.when(n < 2, F.raise_error(F.lit("a gradient needs at least two points per axis")).cast("array<double>")).otherwise(F.transform(values, at))


def reflected(values, negate: bool | Column = False, low=None, high=None) -> Column:
    """An array back to front, negated on request; with low and high its elements become low + high - x."""
    out = F.reverse(col(values))
    if low is not None:
        return F.transform(col(values), lambda x: col(low) + col(high) - x)
    if isinstance(negate, bool):
        return F.transform(out, lambda x: -x + F.lit(0.0)) if negate else out
    return F.when(negate, F.transform(out, lambda x: -x + F.lit(0.0))).otherwise(out)


def hypot_lines(xs, ys) -> Column:
    return F.zip_with(col(xs), col(ys), lambda a, b: F.hypot(a, b))


def hash_uniform(seed: int, *keys) -> Column:
    """A draw in [0, 1) from the keys alone: the same under any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *[col(k) if not isinstance(k, str) else F.col(k) for k in keys]), F.lit(1 << 52)) / F.lit(float(1 << 52))
