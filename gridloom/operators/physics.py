"""Wall heat flux and the predicates around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import above, below, col
from gridloom.functions.fixed import HEAT_FLUX


def dimensional_temperature(theta, bulk, scale) -> Column:
    """bulk + theta * (scale - bulk), in degrees C."""
    return col(bulk) + col(theta) * (col(scale) - col(bulk))


def is_liquid(dfun="dfun") -> Column:
    """Liquid where the signed distance is negative; NaN is vapour, as a comparison with it is false."""
    return below(dfun, 0.0)


def near_interface(dfun, band, spacing) -> Column:
    return below(F.abs(col(dfun)), col(band) * col(spacing))


def away_from_interface(dfun, band, spacing) -> Column:
    return above(F.abs(col(dfun)), col(band) * col(spacing))


def heater_heat_flux(pairs: DataFrame, heaters: DataFrame) -> DataFrame:
    """(case_id, heater, frame, i, x, flux, liquid): conduction from each heater into the first row of cells above it.

    pairs: (case_id, frame, j, temperature, dfun) lines with x, y centre arrays; heaters: (case_id, heater, type, xMin,
    xMax, yMax, wall_temp, bulk_temp, wall_temp_scale, length_scale, thco_liquid, thcogas), small. The row is the
    first strictly above the heater, found from the coordinates alone, so only its lines are read on."""
    fixed = F.when(F.col("type") == HEAT_FLUX, F.raise_error(F.lit("a heater with a fixed flux has no wall temperature to compute with")).cast("double")).otherwise(F.col("wall_temp"))
    known = heaters.withColumn("wall_temp", fixed)
    joined = pairs.join(F.broadcast(known), "case_id")  # heaters: a few a case
    row = F.array_min(F.filter(F.transform(F.col("y"), lambda v, k: F.when(v > F.col("yMax"), k)), lambda k: k.isNotNull()))
    over = F.exists(F.col("x"), lambda v: (v >= F.col("xMin")) & (v <= F.col("xMax")))
    row = F.when(row.isNull() | ~over, F.raise_error(F.lit("a heater has no cells above it on the grid")).cast("int")).otherwise(row)
    lines = joined.where(F.col("j") == row)
    matched = F.when(F.size("temperature") == F.size("dfun"), F.arrays_zip("x", "temperature", "dfun")).otherwise(F.raise_error(F.lit("temperature and dfun are not on the same grid")).cast("array<struct<x:double,temperature:double,dfun:double>>"))
    cells = lines.select("*", F.posexplode(matched).alias("i", "c")).where((F.col("c.x") >= F.col("xMin")) & (F.col("c.x") <= F.col("xMax")))
    liquid = is_liquid("c.dfun")
    conductivity = F.when(liquid, F.col("thco_liquid")).otherwise(F.col("thcogas") * F.col("thco_liquid"))
    distance = (F.get("y", "j") - F.col("yMax")) * F.col("length_scale")
    flux = conductivity * (F.col("wall_temp") - dimensional_temperature("c.temperature", "bulk_temp", "wall_temp_scale")) / distance
    return cells.select("case_id", "heater", "frame", "i", F.col("c.x").alias("x"), flux.alias("flux"), liquid.alias("liquid"))
