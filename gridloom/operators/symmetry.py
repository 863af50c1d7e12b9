"""Mirroring about x = 0 and reflections of fields, heaters and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from gridloom.functions.expr import reflected
from gridloom.functions.fixed import GRAVITY, NEGATED_BY_X_FLIP, NEGATED_BY_Y_FLIP


def on_axis(x) -> Column:
    return F.abs(x) <= F.lit(1e-8)


def _image(values, skip_first: Column, sign: Column) -> Column:
    """values back to front, without the sample on the axis, times sign."""
    rest = F.when(skip_first, F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))).otherwise(F.col(values))
    return F.transform(F.reverse(rest), lambda v: sign * v + F.lit(0.0))


def mirror_rows(rows: DataFrame, x: str = "x", negated=NEGATED_BY_X_FLIP) -> DataFrame:
    """Lines and their x coordinates over [-x_max, x_max]. A sample on the axis is kept once. A grid that starts
    left of the axis is an error; only its first coordinate is looked at."""
    start = F.get(F.col(x), F.lit(0))
    axis = on_axis(start)
    guard = F.when(~axis & (start < 0), F.raise_error(F.lit("the field already extends to x < 0")).cast("array<double>"))
    sign = F.when(F.col("field").isin(list(negated)), F.lit(-1.0)).otherwise(F.lit(1.0))
    vals = guard.otherwise(F.concat(_image("vals", axis, sign), "vals"))
    coords = F.concat(_image(x, axis, F.lit(-1.0)), x)
    return rows.withColumn("__v", vals).withColumn("__x", coords).drop("vals", x).withColumnRenamed("__v", "vals").withColumnRenamed("__x", x)


def mirror_grid(grid: DataFrame) -> DataFrame:
    """(case_id, axis, loc, coords): the x coordinates over the full domain, others as they are."""
    whole = F.concat(_image("coords", on_axis(F.get("coords", F.lit(0))), F.lit(-1.0)), "coords")
    return grid.withColumn("coords", F.when(F.col("axis") == "x", whole).otherwise(F.col("coords")))


def _picked(name: str) -> Column:
    return F.transform("__k", lambda k: F.get(F.col(name), k))


def mirror_heaters(heaters: DataFrame) -> DataFrame:
    """Nucleation sites off the axis gain images, in reversed order before the originals; x is negated."""
    off = F.expr("filter(transform(nuc_sites_x, (x, k) -> struct(abs(x) > 1e-8 AS o, k)), s -> s.o)")
    images = F.reverse(F.transform(off, lambda s: s["k"]))
    out = heaters.withColumn("__k", images)
    for name in ("nuc_sites_y", "nuc_sites_z", "nuc_seed_radii"):
        if name in heaters.columns:
            out = out.withColumn(name, F.when(F.col(name).isNotNull(), F.concat(_picked(name), name)))
    return out.withColumn("nuc_sites_x", F.concat(F.transform("__k", lambda k: -F.get("nuc_sites_x", k)), "nuc_sites_x")).drop("__k")


def require_symmetry(discretization: DataFrame) -> DataFrame:
    """Rows with x_min and the left boundary's type, failing unless x = 0 is a slip wall on the left."""
    slip = F.contains("left_type", F.lit("slip")) & ~F.contains("left_type", F.lit("noslip"))
    ok = on_axis(F.col("x_min")) & F.coalesce(slip, F.lit(False))
    return discretization.withColumn("x_min", F.when(ok, F.col("x_min")).otherwise(F.raise_error(F.lit("a mirrored case needs a slip wall at x = 0 on its left")).cast("double")))


def mirror_parameters(discretization: DataFrame) -> DataFrame:
    """x_min, num_blocks_x and the left boundary of the full domain."""
    return require_symmetry(discretization).withColumn("x_min", -F.col("x_max") + 0 * F.col("x_min")).withColumn("num_blocks_x", 2 * F.col("num_blocks_x")).withColumn("mirrored_about_x", F.lit(0.0)).withColumn("left_type", F.col("right_type"))


def flippable(gravx="gravx", gravy="gravy", gravz="gravz") -> Column:
    """struct<x, y>: the axes without gravity; none at all, or gravity out of the plane, is an error."""
    g = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (gravx, gravy, gravz)]
    free = F.struct((g[0] == 0).alias("x"), (g[1] == 0).alias("y"))
    fail = lambda text: F.raise_error(F.lit(text)).cast("struct<x:boolean,y:boolean>")
    return F.when(g[2] != 0, fail("gravity points out of the plane")).when((g[0] == 0) & (g[1] == 0), fail(f"no gravity among {GRAVITY}: no axis to flip")).otherwise(free)


def flip_rows(rows: DataFrame, flip_x: str = "flip_x", flip_y: str = "flip_y") -> DataFrame:
    """Lines reflected where the row's flags say so: x turns lines over, y renumbers them (ny: lines of the field)."""
    if isinstance(rows.schema["vals"].dataType.elementType, ArrayType):
        raise ValueError("only two-dimensional fields are flipped: a line is an array of numbers")
    neg_x = F.col("field").isin(list(NEGATED_BY_X_FLIP)) & F.col(flip_x)
    neg_y = F.col("field").isin(list(NEGATED_BY_Y_FLIP)) & F.col(flip_y)
    turned = F.when(F.col(flip_x), reflected("vals")).otherwise(F.col("vals"))
    signed = F.when(neg_x != neg_y, F.transform(turned, lambda v: -v + F.lit(0.0))).otherwise(turned)
    return rows.withColumn("vals", signed).withColumn("j", F.when(F.col(flip_y), F.col("ny") - 1 - F.col("j")).otherwise(F.col("j")))


def reflect_heaters(heaters: DataFrame, axis: str, low: str, high: str, flag: str) -> DataFrame:
    """Extent and sites along an axis ("x" or "y") become low + high - value where the flag holds."""
    lo, hi, sites = f"{axis}Min", f"{axis}Max", f"nuc_sites_{axis}"
    total = F.col(low) + F.col(high)
    flip = lambda own, other: F.when(F.col(flag) & F.col(lo).isNotNull() & F.col(hi).isNotNull(), total - F.col(other)).otherwise(F.col(own))
    moved = heaters.withColumn("__lo", flip(lo, hi)).withColumn("__hi", flip(hi, lo))
    moved = moved.withColumn(sites, F.when(F.col(flag), F.transform(sites, lambda s: total - s)).otherwise(F.col(sites)))
    return moved.drop(lo, hi).withColumnRenamed("__lo", lo).withColumnRenamed("__hi", hi)


def swap_sides(boundary: DataFrame, axis: str, flag: str) -> DataFrame:
    """left and right (or bottom and top) types change places where the flag holds."""
    a, b = ("left_type", "right_type") if axis == "x" else ("bottom_type", "top_type")
    return boundary.withColumn("__a", F.when(F.col(flag), F.col(b)).otherwise(F.col(a))).withColumn("__b", F.when(F.col(flag), F.col(a)).otherwise(F.col(b))).drop(a, b).withColumnRenamed("__a", a).withColumnRenamed("__b", b)
