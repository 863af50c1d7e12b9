"""Grids: faces and centres from the discretization, inference of a field's place, on-grid checks, spacings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import allclose, linspace, midpoints, uniform_spacing


def build_grid(discretization: DataFrame) -> DataFrame:
    """(case_id, axis, loc, coords) from x_min, x_max, num_blocks_x, nx_block and the same for y."""
    parts = []
    for axis in ("x", "y"):
        faces = discretization.select("case_id", F.lit(axis).alias("axis"), linspace(f"{axis}_min", f"{axis}_max", F.col(f"num_blocks_{axis}") * F.col(f"n{axis}_block")).alias("faces"))
        parts.append(faces.select("case_id", "axis", F.explode(F.array(F.struct(F.lit("faces").alias("loc"), F.col("faces").alias("coords")), F.struct(F.lit("centers").alias("loc"), midpoints("faces").alias("coords")))).alias("g")).select("case_id", "axis", "g.loc", "g.coords"))
    return parts[0].unionByName(parts[1])


def shapes(rows: DataFrame) -> DataFrame:
    """(case_id, field, frames, ny, nx), failing on ragged lines: a field's frames share one shape."""
    per = rows.groupBy("case_id", "field", "frame").agg(F.count("*").alias("ny"), F.min(F.size("vals")).alias("nx"), F.max(F.size("vals")).alias("nx_max"))
    out = per.groupBy("case_id", "field").agg(F.count("*").alias("frames"), F.min("ny").alias("ny"), F.max("ny").alias("ny_max"), F.min("nx").alias("nx"), F.max("nx_max").alias("nx_max"))
    even = (F.col("ny") == F.col("ny_max")) & (F.col("nx") == F.col("nx_max"))
    return out.select("case_id", "field", "frames", "ny", F.when(even, F.col("nx")).otherwise(F.raise_error(F.concat(F.lit("ragged field "), F.col("field"))).cast("int")).alias("nx"))


def infer_locations(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """(case_id, field, x_loc, y_loc) by extent, centres before faces; null where an extent is neither."""
    wide = grid.groupBy("case_id").agg(*[F.max(F.when((F.col("axis") == a) & (F.col("loc") == p), F.size("coords"))).alias(f"{a}_{p}") for a in "xy" for p in ("centers", "faces")])
    place = lambda n, axis: F.when(F.col(n) == F.col(f"{axis}_centers"), "centers").when(F.col(n) == F.col(f"{axis}_faces"), "faces")
    return shapes(rows).join(wide, "case_id").select("case_id", "field", place("nx", "x").alias("x_loc"), place("ny", "y").alias("y_loc"))


def require_located(located: DataFrame) -> DataFrame:
    """located, failing where a field lies on neither cells nor faces."""
    check = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("no grid place for "), F.col("field"))))
    return located.withColumn("x_loc", check("x_loc")).withColumn("y_loc", check("y_loc"))


def on_grid(coords: DataFrame, grid: DataFrame) -> DataFrame:
    """(case_id, field, axis, on_grid) of field coordinates (case_id, field, axis, coords): close to centres or faces."""
    pairs = coords.join(grid.withColumnRenamed("coords", "expected"), ["case_id", "axis"])
    return pairs.groupBy("case_id", "field", "axis").agg(F.bool_or(allclose("coords", "expected")).alias("on_grid"))


def spacings(grid: DataFrame) -> DataFrame:
    """(case_id, axis, spacing) from evenly spaced centres."""
    return grid.where("loc = 'centers'").select("case_id", "axis", uniform_spacing("coords").alias("spacing"))


def sample_spacing(low, high, size, is_face):
    """(high - low) / cells as float, a face axis having one sample more than cells."""
    return ((F.col(high) - F.col(low)) / (F.col(size) - F.col(is_face).cast("int"))).cast("float")


def frame_counts(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """(case_id, field) whose number of frames isn't that of the case's time."""
    have = rows.groupBy("case_id", "field").agg(F.countDistinct("frame").alias("have"))
    want = frames.groupBy("case_id").agg(F.count("*").alias("want"))
    return have.join(want, "case_id", "left").where("want IS NULL OR have <> want").select("case_id", "field", "have", "want")
