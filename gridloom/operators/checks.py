"""Data-quality checks. Each gives rows (case_id, seq, severity, check, message); run_all unions them in a fixed order.

Comparisons follow NumPy: NaN compares false. Two decisions: the frame list of the divergence check skips NaN cells
(a frame with a NaN cell still counts by its other cells), and medians over a band that holds a NaN stay silent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import above, divide, is_finite, isclose, midpoints
from gridloom.functions.fixed import EXPECTED_PHYSICAL, HEAT_FLUX, HEATER_SHARED_KEYS, MUST_BE_POSITIVE, NON_DIMENSIONAL, PHYSICAL_UNITS, REQUIRED_DISCRETIZATION
from gridloom.operators.stencil import face_divergence, gradient_norm, pair_fields, paired

ERROR, WARNING = "error", "warning"


def issue(check: str, severity: str | Column, message: Column) -> list[Column]:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return [severity.alias("severity"), F.lit(check).alias("check"), message.alias("message")]


def abbreviated(frames: Column, limit: int = 10) -> Column:
    """The first frames of a list, and dots for more."""
    shown = F.concat(F.lit("["), F.array_join(F.transform(F.slice(frames, 1, limit), lambda x: x.cast("string")), ", "), F.lit("]"))
    return F.concat(shown, F.when(F.size(frames) > limit, F.lit(" ...")).otherwise(F.lit("")))


def check_parameters(params: DataFrame) -> DataFrame:
    """Missing and non-positive parameters, parameters without a unit, and inconsistent physical ones."""
    spark, cases = params.sparkSession, params.select("case_id").distinct()
    wanted = [("discretization", n, ERROR) for n in REQUIRED_DISCRETIZATION] + [("non_dimensional", n, ERROR) for n in NON_DIMENSIONAL.values()] + [("physical", n, WARNING) for n in EXPECTED_PHYSICAL]
    names = spark.createDataFrame([(*w, k) for k, w in enumerate(wanted)], "grp string, name string, severity string, place int")
    missing = cases.crossJoin(F.broadcast(names)).join(params, ["case_id", "grp", "name"], "left_anti")  # the names: a fixed list
    each = missing.where("grp = 'discretization'").select("case_id", *issue("parameters", ERROR, F.concat(F.lit("discretization is missing "), F.col("name"), F.lit(", needed for the grid"))))
    listed = missing.where("grp <> 'discretization'").groupBy("case_id", "grp").agg(F.first("severity").alias("s"), F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
    listed = listed.select("case_id", *issue("parameters", F.col("s"), F.concat(F.col("grp"), F.lit(" is missing "), F.array_join("names", ", "))))
    positive = F.lit(False)
    for group, keys in MUST_BE_POSITIVE.items():
        positive = positive | ((F.col("grp") == group) & F.col("name").isin(list(keys)))
    negative = params.where(positive & (F.col("kind") == "number") & ~above("value", 0.0)).select("case_id", *issue("parameters", ERROR, F.concat(F.col("grp"), F.lit(" "), F.col("name"), F.lit(" must be positive"))))
    unitless = params.where((F.col("grp") == "physical") & F.col("kind").isin("number", "bool") & ~F.col("name").isin(list(PHYSICAL_UNITS)))
    unitless = unitless.groupBy("case_id").agg(F.array_sort(F.collect_set("name")).alias("names")).select("case_id", *issue("parameters", WARNING, F.concat(F.lit("physical parameters without a unit: "), F.array_join("names", ", "))))
    return each.unionByName(listed).unionByName(negative).unionByName(unitless).unionByName(check_consistency(params))


def physical_values(params: DataFrame) -> DataFrame:
    """One row a case: the temperatures and scales, null where absent."""
    at = lambda g, n: F.max(F.when((F.col("grp") == g) & (F.col("name") == n), F.col("value"))).alias(n)
    return params.groupBy("case_id").agg(*[at("physical", n) for n in EXPECTED_PHYSICAL], at("non_dimensional", "tsat"), at("non_dimensional", "thcogas"))


def check_consistency(params: DataFrame) -> DataFrame:
    """Rules between the physical temperatures and scales."""
    p = physical_values(params)
    wall, bulk, sat = F.col("wall_temp_scale"), F.col("bulk_temp"), F.col("sat_temp")
    hot = above(wall, bulk)
    length, velocity, time = F.col("length_scale"), F.col("velocity_scale"), F.col("time_scale")
    rules = [
        (wall.isNotNull() & bulk.isNotNull() & ~hot, ERROR, "wall_temp_scale is not above bulk_temp"),
        (above(bulk, sat), WARNING, "bulk_temp is above sat_temp: the bulk is superheated"),
        ((velocity != 0) & ~isclose(time, divide(length, velocity), rtol=1e-3), WARNING, "time_scale is not length_scale / velocity_scale"),
        (hot & ~isclose("tsat", divide(sat - bulk, wall - bulk), atol=1e-3), WARNING, "tsat does not match the physical temperatures"),
    ]
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(m).alias("m"))) for k, (c, s, m) in enumerate(rules)])
    return p.select("case_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("case_id", *issue("parameters", F.col("x.s"), F.col("x.m")))


def check_heaters(cases: DataFrame, heaters: DataFrame) -> DataFrame:
    """cases: (case_id, x_min, x_max, bulk_temp, wall_temp_scale); heaters: (case_id, heater, keys, typed columns)."""
    none = cases.join(heaters, "case_id", "left_anti").select("case_id", F.lit(-1).alias("heater"), F.lit(0).alias("k"), *issue("heaters", WARNING, F.lit("the case has no heaters")))
    h = heaters.join(cases, "case_id")
    needed = F.concat(F.array(*[F.lit(k) for k in HEATER_SHARED_KEYS]), F.when(F.col("type") == HEAT_FLUX, F.array(F.lit("heat_flux"))).otherwise(F.array(F.lit("wall_temp_fraction"))))
    missing = F.array_except(needed, "keys")
    whole = F.size(missing) == 0
    derived = F.col("bulk_temp") + F.col("wall_temp_fraction") * (F.col("wall_temp_scale") - F.col("bulk_temp"))
    outside = F.filter("nuc_sites_x", lambda x: ~((x >= F.col("xMin")) & (x <= F.col("xMax")) & ~F.isnan(x)))
    name = F.concat(F.lit("heater "), F.col("heater").cast("string"))
    rules = [
        (~whole, ERROR, F.concat(name, F.lit(" is missing "), F.array_join(missing, ", "))),
        (whole & F.col("wall_temp").isNotNull() & derived.isNotNull() & ~isclose("wall_temp", derived, rtol=1e-6), WARNING, F.concat(name, F.lit(" wall_temp does not match its fraction"))),
        (whole & ~above("xMax", "xMin"), ERROR, F.concat(name, F.lit(" has no extent along x"))),
        (whole & ((F.col("xMax") <= F.col("x_min")) | (F.col("xMin") >= F.col("x_max"))), ERROR, F.concat(name, F.lit(" lies outside the domain along x"))),
        (whole & (F.size(outside) > 0), WARNING, F.concat(name, F.lit(" has nucleation sites off it at "), F.array_join(F.transform(outside, lambda x: x.cast("string")), ", "))),
    ]
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), m.alias("m"))) for k, (c, s, m) in enumerate(rules)])
    rows = h.select("case_id", "heater", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("case_id", "heater", F.col("x.k").alias("k"), *issue("heaters", F.col("x.s"), F.col("x.m")))
    return none.unionByName(rows)


def time_steps(frames: DataFrame) -> DataFrame:
    """(case_id, frame, step): the step from each frame to the next."""
    w = Window.partitionBy("case_id").orderBy("frame")
    return frames.withColumn("step", F.lead("time").over(w) - F.col("time")).where("step IS NOT NULL").select("case_id", "frame", "step")


def uniform_step(frames: DataFrame, rtol: float = 1e-2) -> DataFrame:
    """(case_id, steps, dt, even): the mean step and whether every step is within rtol of it."""
    steps = time_steps(frames)
    mean = steps.groupBy("case_id").agg(F.avg("step").alias("dt"), F.count("*").alias("steps"), F.min("step").alias("lo"), F.max("step").alias("hi"))
    far = F.greatest(F.abs(F.col("lo") - F.col("dt")), F.abs(F.col("hi") - F.col("dt")))
    return mean.select("case_id", "steps", "dt", (far <= F.lit(rtol) * F.abs("dt")).alias("even"))


def check_time(frames: DataFrame, rtol: float = 1e-2) -> DataFrame:
    """Steps that aren't positive (with the earlier frames), else uneven ones."""
    s = time_steps(frames).groupBy("case_id").agg(
        F.avg("step").alias("dt"), F.min("step").alias("lo"), F.max("step").alias("hi"),
        F.array_sort(F.collect_list(F.when(~above("step", 0.0), F.col("frame")))).alias("bad"),
    )
    uneven = F.greatest(F.abs(F.col("lo") - F.col("dt")), F.abs(F.col("hi") - F.col("dt"))) > F.lit(rtol) * F.abs("dt")
    text = F.when(F.size("bad") > 0, F.concat(F.lit("time is not strictly increasing at frames ["), F.array_join(F.transform("bad", lambda x: x.cast("string")), ", "), F.lit("]"))).when(uneven, F.lit("frames are unevenly spaced"))
    severity = F.when(F.size("bad") > 0, ERROR).otherwise(WARNING)
    return s.withColumn("__m", text).where("__m IS NOT NULL").select("case_id", *issue("time", severity, F.col("__m")))


def nonfinite_counts(rows: DataFrame) -> DataFrame:
    """(case_id, field, bad, frames): NaN and infinite values and the frames that hold them."""
    bad = rows.withColumn("n", F.size(F.filter("vals", lambda v: ~is_finite(v)))).where("n > 0")
    return bad.groupBy("case_id", "field").agg(F.sum("n").alias("bad"), F.array_sort(F.collect_set("frame")).alias("frames"))


def check_finite(rows: DataFrame) -> DataFrame:
    return nonfinite_counts(rows).select("case_id", *issue("finite", ERROR, F.concat(F.col("field"), F.lit(" has "), F.col("bad").cast("string"), F.lit(" NaN or infinite values in frames "), abbreviated(F.col("frames")))))


def finite_range(rows: DataFrame, field: str = "temperature") -> DataFrame:
    """(case_id, low, high) of a field's finite values, reduced line by line before the exchange."""
    good = rows.where(F.col("field") == field).select("case_id", F.filter("vals", is_finite).alias("v")).where("size(v) > 0")
    return good.groupBy("case_id").agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"))


def check_temperature(rows: DataFrame, bounds: DataFrame, tolerance: float = 1e-2) -> DataFrame:
    """bounds: (case_id, tsat, hottest): hottest the greatest wall fraction, 1 where no heater has one."""
    r = finite_range(rows).join(bounds, "case_id")
    lower, upper = F.least(F.lit(0.0), F.coalesce("tsat", F.lit(0.0))), F.coalesce("hottest", F.lit(1.0))
    out = (F.col("low") < lower - tolerance) | (F.col("high") > upper + tolerance)
    return r.where(out).select("case_id", *issue("temperature", WARNING, F.concat(F.lit("temperature leaves the bulk to wall range: "), F.format_string("%.4g to %.4g", "low", "high"))))


def interface_slope(rows: DataFrame, band: float = 4.0) -> DataFrame:
    """(case_id, median, any_nan): the exact median of |grad dfun| within band cells of the interface; rows have x, y."""
    dfun = rows.where("field = 'dfun'")
    smallest = lambda c: F.array_min(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: b - a))
    spacing = F.least(smallest("x"), smallest("y"))
    slope = gradient_norm(dfun.withColumn("own", F.col("vals")).withColumn("spacing", spacing))
    cells = slope.select("case_id", "spacing", F.explode(F.arrays_zip("own", F.col("vals").alias("slope"))).alias("c"))
    near = cells.where(above(F.lit(band) * F.col("spacing"), F.abs(F.col("c.own"))))
    return near.groupBy("case_id").agg(F.median("c.slope").alias("median"), F.bool_or(F.isnan("c.slope")).alias("any_nan"))


def check_signed_distance(rows: DataFrame, band: float = 4.0, tolerance: float = 0.1) -> DataFrame:
    s = interface_slope(rows, band).where(~F.col("any_nan") & (F.abs(F.col("median") - 1) > tolerance))
    return s.select("case_id", *issue("signed distance", WARNING, F.concat(F.lit("the median slope of dfun near the interface is "), F.format_string("%.3g", "median"), F.lit(", not 1"))))


def peak(lines: Column) -> Column:
    """The greatest absolute value of a line that isn't NaN."""
    return F.array_max(F.transform(F.filter(lines, lambda v: ~F.isnan(v)), lambda v: F.abs(v)))


def relative_peak(diff: Column, scale: Column) -> Column:
    """Aggregate: max|diff| / max|scale|, NaN ignored, an all-zero scale counting as 1."""
    top = F.max(peak(scale))
    return F.max(peak(diff)) / F.when(top == 0, F.lit(1.0)).otherwise(top)


def cell_face_errors(rows: DataFrame, center: str, face: str, along_y: bool) -> DataFrame:
    """(case_id, error, fits): how far cell values are from the means of their faces, relative to the face peak."""
    both = pair_fields(rows, center, face)
    if along_y:
        ahead = F.lead(face).over(paired())
        both = both.withColumn("mean", F.zip_with(F.col(face), ahead, lambda a, b: F.lit(0.5) * (a + b)))
    else:
        both = both.withColumn("mean", midpoints(face))
    fits = (F.col(center).isNull() == F.col("mean").isNull()) & F.coalesce(F.size(center) == F.size("mean"), F.lit(True))
    diff = F.when(fits & F.col(center).isNotNull(), F.zip_with(center, "mean", lambda c, m: c - m))
    have = both.groupBy("case_id").agg(relative_peak(diff, F.col(face)).alias("error"), F.bool_and(fits).alias("fits"), F.count(center).alias("cells"), F.count(face).alias("faces"))
    return have.where("cells > 0 AND faces > 0").select("case_id", "error", "fits")


def check_cell_face(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    out = None
    for center, face, along_y in (("velx", "velfacex", False), ("vely", "velfacey", True)):
        e = cell_face_errors(rows, center, face, along_y).where(~F.col("fits") | (F.col("error") > tolerance))
        text = F.when(~F.col("fits"), F.lit(f"{face} does not surround the cells of {center}")).otherwise(F.concat(F.lit(f"{center} differs from the mean of {face} by up to "), F.format_string("%.3g", "error"), F.lit(" of the peak velocity")))
        part = e.select("case_id", *issue("cell/face velocity", ERROR, text))
        out = part if out is None else out.unionByName(part)
    return out


def divergence_errors(rows: DataFrame, grid: DataFrame, band: float = 4.0, tolerance: float = 1e-6) -> DataFrame:
    """(case_id, error, frames): greatest divergence away from the interface in peak velocities per cell, and the frames
    beyond the tolerance. grid: (case_id, x_faces, y_faces). Without dfun every cell counts."""
    p = pair_fields(rows, "velfacex", "velfacey", "dfun").join(grid, "case_id")
    tops = p.groupBy("case_id").agg(F.max(F.greatest(F.coalesce(peak(F.col("velfacex")), F.lit(0.0)), F.coalesce(peak(F.col("velfacey")), F.lit(0.0)))).alias("top"), F.count("dfun").alias("with_dfun"))
    step = lambda c: F.array_min(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: b - a))
    d = face_divergence(p).withColumn("cell", F.least(step("x_faces"), step("y_faces"))).join(tops, "case_id")
    mask = F.when(F.col("with_dfun") == 0, F.col("vals")).when(F.size("dfun") == F.size("vals"), F.zip_with("vals", "dfun", lambda v, s: F.when(above(F.abs(s), F.lit(band) * F.col("cell")), v)))
    mask = mask.otherwise(F.raise_error(F.lit("dfun is not on the cells between the faces")).cast("array<double>"))
    worst = F.array_max(F.transform(F.filter(mask, lambda v: v.isNotNull() & ~F.isnan(v)), lambda v: F.abs(v))) * F.col("cell")
    scale = F.when(F.col("top") == 0, F.lit(1.0)).otherwise(F.col("top"))
    per = d.groupBy("case_id", "frame").agg(F.max(worst / scale).alias("e")).where("e IS NOT NULL")
    return per.groupBy("case_id").agg(F.max("e").alias("error"), F.array_sort(F.collect_list(F.when(F.col("e") > tolerance, F.col("frame")))).alias("frames"))


def check_divergence(rows: DataFrame, grid: DataFrame, band: float = 4.0, tolerance: float = 1e-6) -> DataFrame:
    e = divergence_errors(rows, grid, band, tolerance).where(F.col("error") > tolerance)
    return e.select("case_id", *issue("divergence", ERROR, F.concat(F.lit("divergence away from the interface reaches "), F.format_string("%.3g", "error"), F.lit(" of the peak velocity per cell, in frames "), abbreviated(F.col("frames")))))


def run_all(checks: Sequence[DataFrame]) -> DataFrame:
    """The issues of several checks with `seq` in their order."""
    out = None
    for k, c in enumerate(checks):
        part = c.select("case_id", F.lit(k).alias("seq"), "severity", "check", "message")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("case_id", "seq")


def exit_code(issues: DataFrame) -> int:
    """1 if any issue is an error."""
    return int(not issues.where(F.col("severity") == ERROR).isEmpty())
