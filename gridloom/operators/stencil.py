"""Finite differences on grid lines: x stencils are array expressions without a shuffle; y stencils look at the lines
before and after within (case, field, frame), one exchange and sort for all that a query needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import central, differences, gradient, midpoints


def lines():
    """The lines of one field and frame, in order."""
    return Window.partitionBy("case_id", "field", "frame").orderBy("j")


def paired():
    """The lines of one frame with fields side by side."""
    return Window.partitionBy("case_id", "frame").orderBy("j")


def diff_x(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vals", differences("vals"))


def diff_y(rows: DataFrame) -> DataFrame:
    """Differences of neighbouring lines; one line fewer."""
    return _with_next(rows, lambda here, there: F.zip_with(here, there, lambda a, b: b - a))


def average_y(rows: DataFrame) -> DataFrame:
    """Means of neighbouring lines: cell values from y-face values."""
    return _with_next(rows, lambda here, there: F.zip_with(here, there, lambda a, b: F.lit(0.5) * (a + b)))


def average_x(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vals", midpoints("vals"))


def _with_next(rows: DataFrame, combine) -> DataFrame:
    paired = rows.withColumn("__next", F.lead("vals").over(lines()))
    return paired.where("__next IS NOT NULL").withColumn("vals", combine(F.col("vals"), F.col("__next"))).drop("__next")


def gradient_x(rows: DataFrame, coords="x") -> DataFrame:
    """d/dx by second-order differences, one-sided at the walls; coords: a column (or array) of x."""
    return rows.withColumn("vals", gradient("vals", coords))


def gradient_y(rows: DataFrame, coords="y") -> DataFrame:
    """d/dy likewise, from the neighbouring lines."""
    return rows.withColumn("vals", line_gradient("vals", coords, lines()))


def line_gradient(values: str, coords: str, window) -> Column:
    """d/dy of a column of lines numbered j over coordinates y: the three lines around each, weighted by their distances."""
    before, after, here = F.lag(values).over(window), F.lead(values).over(window), F.col(values)
    y = lambda k: F.get(F.col(coords), F.col("j") + k)
    up, down = y(1) - y(0), y(0) - y(-1)
    inside = F.zip_with(F.arrays_zip(before.alias("b"), here.alias("h")), after, lambda p, a: central(p["b"], p["h"], a, down, up))
    first = F.zip_with(here, after, lambda h, a: (a - h) / up)
    last = F.zip_with(before, here, lambda b, h: (h - b) / down)
    lonely = F.raise_error(F.lit("a gradient needs at least two points per axis")).cast("array<double>")
    return F.when(before.isNull() & after.isNull(), lonely).when(before.isNull(), first).when(after.isNull(), last).otherwise(inside)


def pair_fields(rows: DataFrame, *names: str) -> DataFrame:
    """(case_id, frame, j, one column of lines per field): a pivot by conditional aggregation, one shuffle for all fields."""
    picked = rows.where(F.col("field").isin(list(names)))
    return picked.groupBy("case_id", "frame", "j").agg(*[F.first(F.when(F.col("field") == n, F.col("vals")), ignorenulls=True).alias(n) for n in names])


def same_shape(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs, failing where two fields aren't sampled on one grid."""
    ok = F.coalesce(F.size(a) == F.size(b), F.lit(False))
    return pairs.withColumn(a, F.when(ok, F.col(a)).otherwise(F.raise_error(F.lit(f"{a} and {b} are not on the same grid")).cast("array<double>")))


def vorticity(rows: DataFrame, x="x", y="y", u: str = "velx", v: str = "vely") -> DataFrame:
    """dv/dx - du/dy of cell velocities; rows carry coordinate arrays x and y."""
    coords = rows.groupBy("case_id").agg(F.first(x).alias("x"), F.first(y).alias("y"))
    both = same_shape(pair_fields(rows, u, v), u, v).join(coords, "case_id")
    return both.select("case_id", "frame", "j", F.zip_with(gradient(v, "x"), line_gradient(u, "y", paired()), lambda a, b: a - b).alias("vals"))


def face_divergence(pairs: DataFrame, x_faces="x_faces", y_faces="y_faces", u: str = "velfacex", v: str = "velfacey") -> DataFrame:
    """diff(u)/dx + diff(v)/dy of the cells between the faces; pairs from pair_fields with face coordinate arrays."""
    dy = F.get(F.col(y_faces), F.col("j") + 1) - F.get(F.col(y_faces), F.col("j"))
    ahead = pairs.withColumn("__up", F.lead(v).over(paired())).where(F.col("__up").isNotNull() & F.col(u).isNotNull())
    du = F.zip_with(differences(u), differences(x_faces), lambda a, dx: a / dx)
    dv = F.zip_with(F.col(v), F.col("__up"), lambda a, b: (b - a) / dy)
    return ahead.withColumn("vals", F.zip_with(du, dv, lambda a, b: a + b)).drop("__up")


def cell_divergence(pairs: DataFrame, x="x", y="y", u: str = "velx", v: str = "vely") -> DataFrame:
    """Central differences of cell velocities, one-sided at the walls."""
    return pairs.withColumn("vals", F.zip_with(gradient(u, x), line_gradient(v, y, paired()), lambda a, b: a + b))


def face_speed(pairs: DataFrame, u: str = "velfacex", v: str = "velfacey") -> DataFrame:
    """Velocity magnitude at the cells from the averages of their faces."""
    ahead = pairs.withColumn("__up", F.lead(v).over(paired())).where(F.col("__up").isNotNull() & F.col(u).isNotNull())
    mean_v = F.zip_with(F.col(v), F.col("__up"), lambda a, b: F.lit(0.5) * (a + b))
    return ahead.withColumn("vals", F.zip_with(midpoints(u), mean_v, lambda a, b: F.hypot(a, b))).drop("__up")


def cell_speed(pairs: DataFrame, u: str = "velx", v: str = "vely") -> DataFrame:
    return pairs.withColumn("vals", F.zip_with(F.col(u), F.col(v), lambda a, b: F.hypot(a, b)))


def gradient_norm(rows: DataFrame, x="x", y="y") -> DataFrame:
    """hypot of both derivatives of one field."""
    return rows.withColumn("vals", F.zip_with(gradient("vals", x), line_gradient("vals", y, lines()), lambda a, b: F.hypot(a, b)))


def percentile_or_one(values: DataFrame, q: float, *by: str, value: str = "value") -> DataFrame:
    """The exact q-quantile (linear interpolation) of absolute values, 1 if it is zero."""
    p = F.percentile(F.abs(F.col(value)), F.lit(q))
    return values.groupBy(*by).agg(p.alias("p")).select(*by, F.when(F.col("p") == 0, F.lit(1.0)).otherwise(F.col("p")).alias("p"))


def temporal_mean(rows: DataFrame) -> DataFrame:
    """(case_id, field, j, i, mean): each cell's mean over the frames."""
    cells = rows.select("case_id", "field", "j", F.posexplode("vals").alias("i", "value"))
    return cells.groupBy("case_id", "field", "j", "i").agg(F.avg("value").alias("mean"))
