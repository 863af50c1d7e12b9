"""Every registered query over the driver's tables, with its DuckDB counterpart.

A query is a function of (spark, sf_dir) under @query, with its SQL; floating output is rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import config as cfg
from gridloom.functions.expr import midpoints
from gridloom.operators import augment, blocks, checks, dmd, grid, normalize, physics, slicing, split, statistics, stencil, symmetry, windows
from gridloom.plans import adapters as a
from gridloom.sources import tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def r6_signed(v) -> Column:
    """round(v, 6) as in SQL, where what rounds to zero keeps its sign: for values in arrays, which are compared as they are."""
    rounded = F.round(v, 6)
    return F.when(rounded == 0, F.signum(v) * F.lit(0.0)).otherwise(rounded)


def out_cells(rows: DataFrame, *keep: str, column: str = "vals", name: str = "value") -> DataFrame:
    """Lines -> (keep..., j, i, value) rounded."""
    return rows.select(*keep, F.col("j").cast("int").alias("j"), F.posexplode(column).alias("i", name)).withColumn(name, r6(name))


_REC = "count(v) AS count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max"


def _record(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


# --- statistics


@query(f"WITH {a.GRID_SQL} SELECT case_id, {_REC} FROM cells GROUP BY case_id")
def stats_field(spark, d):
    return _record(statistics.field_statistics(a.grid(spark, d), "case_id"), "case_id")


@query(f"WITH {a.FIELDS_SQL} SELECT field, {_REC.replace('(v)', '(value)').replace('(v)', '(value)')} FROM fields GROUP BY field")
def stats_field_multi(spark, d):
    return _record(statistics.require_data(statistics.value_statistics(a.fields(spark, d), "field")), "field")


@query("""WITH leaves AS (SELECT 'non_dimensional.k' AS path, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events WHERE props IS NOT NULL
  UNION ALL SELECT 'physical.bulk_temp', 58.0 FROM events WHERE props IS NOT NULL UNION ALL SELECT 'discretization.nx_block', 16.0 FROM events WHERE props IS NOT NULL
  UNION ALL SELECT 'heaters.wall_temp_fraction', unnest([0.5, 1.0]) FROM events WHERE props IS NOT NULL)
SELECT path, """ + _REC + " FROM leaves GROUP BY path")
def stats_config(spark, d):
    return _record(statistics.config_statistics(cfg.config_params(a.config_cases(spark, d))), "path")


@query(f"WITH {a.FIELDS_SQL}, pairs AS (SELECT DISTINCT case_id, field FROM fields WHERE NOT (case_id = 'A' AND field = 'l_tax')) SELECT field, count(*) = (SELECT count(DISTINCT case_id) FROM pairs) AS common FROM pairs GROUP BY field")
def stats_common_fields(spark, d):
    rows = a.fields(spark, d).where("NOT (case_id = 'A' AND field = 'l_tax')")
    common, partial = statistics.common_fields(rows)
    return common.withColumn("common", F.lit(True)).unionByName(partial.withColumn("common", F.lit(False)))


# --- selection


@query(f"WITH {a.GRID_SQL} SELECT case_id, frame - 3 AS frame, j, i, round(v, 6) AS value FROM cells WHERE frame >= 3 AND frame < 9")
def slice_frames(spark, d):
    return out_cells(slicing.slice_frames(a.grid(spark, d), slice(3, 9), 10, renumber=True), "case_id", "frame")


@query(f"WITH {a.GRID_SQL}, n AS (SELECT case_id, max(frame) + 1 AS n FROM cells GROUP BY case_id) SELECT case_id, frame, j, i, round(v, 6) AS value FROM cells JOIN n USING (case_id) WHERE frame >= greatest(n - 7, 0) AND frame < n - 1 AND (frame - greatest(n - 7, 0)) % 2 = 0")
def slice_negative_step(spark, d):
    return out_cells(slicing.slice_frames(slicing.with_num_frames(a.grid(spark, d)), slice(-7, -1, 2)), "case_id", "frame")


@query(f"WITH {a.GRID_SQL}, n AS (SELECT case_id, max(frame) + 1 AS n FROM cells GROUP BY case_id) SELECT case_id, frame - 1 AS frame, CAST(n - 2 AS INT) AS num_frames, round(sum(v), 6) AS total FROM cells JOIN n USING (case_id) WHERE frame BETWEEN 1 AND n - 2 GROUP BY ALL")
def drop_end_frames(spark, d):
    rows = slicing.drop_ends(slicing.with_num_frames(a.grid(spark, d)))
    return statistics.cells(rows).groupBy("case_id", "frame", "num_frames").agg(r6(F.sum("value")).alias("total"))


@query(f"WITH {a.GRID_SQL} SELECT case_id, j, i, round(v, 6) AS value FROM cells WHERE frame = 4")
def time_slice(spark, d):
    return out_cells(slicing.time_slice(a.grid(spark, d), 4), "case_id")


@query(f"WITH {a.STAG_SQL}, have AS (SELECT 'velfacex' AS field, count(*) AS n FROM u UNION ALL SELECT 'dfun', count(*) FROM s) SELECT field, n FROM have")
def project_fields(spark, d):
    rows = slicing.select_fields(a.stag(spark, d), ["velfacex", "dfun"], ["velfacex", "velfacey", "dfun", "temperature"])
    return statistics.cells(rows.drop("x", "y", "x_faces", "y_faces")).groupBy("field").agg(F.count("*").alias("n"))


@query("SELECT 'stag' AS case_id, 'pressure' AS field")
def unstored_fields(spark, d):
    wanted = spark.createDataFrame([("stag", "pressure"), ("stag", "dfun")], "case_id string, field string")
    return slicing.unstored(a.stag(spark, d), wanted)


# --- grids


@query("""WITH c(axis, lo, hi, n) AS (VALUES ('x', 0.0, 2.0, 12), ('y', -1.0, 3.0, 8)),
faces AS (SELECT axis, 'faces' AS loc, k AS i, CASE WHEN k = n THEN hi ELSE lo + k * ((hi - lo) / n) END AS coord FROM c, range(0, 13) t(k) WHERE k <= n),
centers AS (SELECT f.axis, 'centers' AS loc, f.i, 0.5 * (f.coord + g.coord) AS coord FROM faces f JOIN faces g ON g.axis = f.axis AND g.i = f.i + 1)
SELECT axis, loc, CAST(i AS INT) AS i, round(coord, 6) AS coord FROM (SELECT * FROM faces UNION ALL SELECT * FROM centers)""")
def grid_faces_centers(spark, d):
    disc = spark.createDataFrame([("a", 0.0, 2.0, 3, 4, -1.0, 3.0, 2, 4)], "case_id string, x_min double, x_max double, num_blocks_x int, nx_block int, y_min double, y_max double, num_blocks_y int, ny_block int")
    return grid.build_grid(disc).select("axis", "loc", F.posexplode("coords").alias("i", "coord")).withColumn("coord", r6("coord"))


def _stag_grid(spark):
    disc = spark.createDataFrame([("stag", 0.0, 2.0, 1, 7, 0.0, 2.0, 1, 7)], "case_id string, x_min double, x_max double, num_blocks_x int, nx_block int, y_min double, y_max double, num_blocks_y int, ny_block int")
    return grid.build_grid(disc)


@query("SELECT * FROM (VALUES ('stag', 'velfacex', 'faces', 'centers'), ('stag', 'velfacey', 'centers', 'faces'), ('stag', 'dfun', 'centers', 'centers'), ('stag', 'temperature', 'centers', 'centers')) t(case_id, field, x_loc, y_loc)")
def grid_infer_location(spark, d):
    return grid.require_located(grid.infer_locations(a.stag(spark, d), _stag_grid(spark)))


@query("""WITH f(field, axis, x0, dx, n) AS (VALUES ('dfun', 'x', 1.0 / 7, 2.0 / 7, 7), ('velfacex', 'x', 0.0, 2.0 / 7, 8), ('bad', 'x', 0.05, 2.0 / 7, 7), ('short', 'x', 0.0, 2.0 / 7, 5))
SELECT 'stag' AS case_id, field, axis, n IN (7, 8) AND abs(x0 - CASE WHEN n = 7 THEN 1.0 / 7 ELSE 0.0 END) <= 1e-8 + 1e-5 * CASE WHEN n = 7 THEN 1.0 / 7 ELSE 0 END AS on_grid FROM f""")
def on_grid_check(spark, d):
    step = 2.0 / 7
    rows = [("stag", f, "x", [x0 + k * step for k in range(n)]) for f, x0, n in (("dfun", 1.0 / 7, 7), ("velfacex", 0.0, 8), ("bad", 0.05, 7), ("short", 0.0, 5))]
    return grid.on_grid(spark.createDataFrame(rows, "case_id string, field string, axis string, coords array<double>"), _stag_grid(spark))


@query("SELECT 'stag' AS case_id, unnest(['x', 'y']) AS axis, round(2.0 / 7, 6) AS spacing")
def grid_spacing(spark, d):
    return grid.spacings(_stag_grid(spark)).withColumn("spacing", r6("spacing"))


# --- time


@query(f"WITH {a.SERIES_SQL} SELECT case_id, frame, round(CASE WHEN frame % 3 = 0 THEN 10.0 + 0.5 * frame ELSE time END, 6) AS time FROM series")
def time_fallback(spark, d):
    s = a.series(spark, d)
    frames = s.select("case_id", "frame", F.lit(10.0).alias("t_initial"), F.lit(0.5).alias("dt"))
    return tables.with_time(frames, s.where("frame % 3 <> 0")).withColumn("time", r6("time"))


_STEPS = f"WITH {a.SERIES_SQL}, steps AS (SELECT case_id, frame, lead(time) OVER (PARTITION BY case_id ORDER BY frame) - time AS step FROM series), known AS (SELECT * FROM steps WHERE step IS NOT NULL)"


@query(_STEPS + " SELECT case_id, count(*) AS steps, round(avg(step), 4) AS dt, greatest(abs(min(step) - avg(step)), abs(max(step) - avg(step))) <= 0.01 * abs(avg(step)) AS even FROM known GROUP BY case_id")
def time_uniform_step(spark, d):
    return checks.uniform_step(a.series(spark, d)).withColumn("dt", F.round("dt", 4))


@query(_STEPS + """ SELECT case_id, CASE WHEN count(*) FILTER (NOT step > 0) > 0 THEN 'error' ELSE 'warning' END AS severity, 'time' AS "check",
CASE WHEN count(*) FILTER (NOT step > 0) > 0 THEN 'time is not strictly increasing at frames [' || string_agg(CAST(frame AS VARCHAR), ', ' ORDER BY frame) FILTER (NOT step > 0) || ']' ELSE 'frames are unevenly spaced' END AS message
FROM known GROUP BY case_id HAVING count(*) FILTER (NOT step > 0) > 0 OR greatest(abs(min(step) - avg(step)), abs(max(step) - avg(step))) > 0.01 * abs(avg(step))""")
def check_time(spark, d):
    return checks.check_time(a.series(spark, d))


# --- checks


@query(f"WITH {a.STAG_SQL}, bad AS (SELECT frame, 2 AS n FROM (SELECT DISTINCT frame FROM s) WHERE frame % 10 = 3) SELECT 'stag' AS case_id, 'error' AS severity, 'finite' AS \"check\", 'dfun has ' || sum(n)::VARCHAR || ' NaN or infinite values in frames [' || array_to_string(list_sort(list(frame))[1:10], ', ') || ']' || CASE WHEN count(*) > 10 THEN ' ...' ELSE '' END AS message FROM bad")
def check_finite(spark, d):
    rows = a.stag(spark, d)
    spoilt = F.when((F.col("field") == "dfun") & (F.col("frame") % 10 == 3) & (F.col("j") == 2), F.transform("vals", lambda v, i: F.when(i == 1, F.lit(float("nan"))).when(i == 2, F.lit(float("inf"))).otherwise(v)))
    return checks.check_finite(rows.withColumn("vals", spoilt.otherwise(F.col("vals"))))


@query(f"WITH {a.STAG_SQL} SELECT 'stag' AS case_id, round(min(v), 6) AS low, round(max(v), 6) AS high, min(v) < -0.01 OR max(v) > 1.01 AS issue FROM th")
def check_temperature(spark, d):
    rows = a.stag(spark, d)
    found = checks.finite_range(rows)
    bounds = spark.createDataFrame([("stag", None, None)], "case_id string, tsat double, hottest double")
    issues = checks.check_temperature(rows, bounds).select("case_id", F.lit(True).alias("issue"))
    return found.join(issues, "case_id", "left").select("case_id", r6("low").alias("low"), r6("high").alias("high"), F.coalesce("issue", F.lit(False)).alias("issue"))


@query(f"""WITH {a.STAG_SQL}, ex AS (SELECT max(abs(c.v - 0.5 * (x.v + y.v))) AS e FROM cu c JOIN u x ON x.frame = c.frame AND x.j = c.j AND x.i = c.i JOIN u y ON y.frame = c.frame AND y.j = c.j AND y.i = c.i + 1),
ey AS (SELECT max(abs(c.v - 0.5 * (x.v + y.v))) AS e FROM cw c JOIN w x ON x.frame = c.frame AND x.j = c.j AND x.i = c.i JOIN w y ON y.frame = c.frame AND y.j = c.j + 1 AND y.i = c.i)
SELECT 'x' AS axis, round(e / (SELECT max(abs(v)) FROM u), 6) AS error, true AS fits FROM ex UNION ALL SELECT 'y', round(e / (SELECT max(abs(v)) FROM w), 6), true FROM ey""")
def check_cell_face(spark, d):
    rows = a.stag_cells(spark, d)
    x = checks.cell_face_errors(rows, "velx", "velfacex", False).select(F.lit("x").alias("axis"), r6("error").alias("error"), "fits")
    return x.unionByName(checks.cell_face_errors(rows, "vely", "velfacey", True).select(F.lit("y").alias("axis"), r6("error").alias("error"), "fits"))


@query(f"""WITH {a.STAG_SQL}, top AS (SELECT greatest((SELECT max(abs(v)) FROM u), (SELECT max(abs(v)) FROM w)) AS t),
away AS (SELECT div.frame, max(abs(div.v)) * (2.0 / 7) / (SELECT t FROM top) AS e FROM div JOIN s ON s.frame = div.frame AND s.j = div.j AND s.i = div.i WHERE abs(s.v) > 0.5 * (2.0 / 7) GROUP BY div.frame)
SELECT 'stag' AS case_id, round(max(e), 6) AS error, list_sort(list(frame) FILTER (e > 1e-6)) AS frames FROM away""")
def check_divergence(spark, d):
    rows = a.stag(spark, d)
    faces = rows.select("case_id", "x_faces", "y_faces").limit(1)
    return checks.divergence_errors(rows, faces, band=0.5).select("case_id", r6("error").alias("error"), "frames")


_GRAD = """CASE WHEN {k} = 0 THEN (nxt - v) / {h} WHEN {k} = {n} THEN (v - prv) / {h} ELSE (nxt - prv) / (2 * {h}) END"""
_SLOPE = f"""sn AS (SELECT *, lead(v) OVER wx AS nx, lag(v) OVER wx AS px, lead(v) OVER wy AS ny, lag(v) OVER wy AS py FROM s WINDOW wx AS (PARTITION BY frame, j ORDER BY i), wy AS (PARTITION BY frame, i ORDER BY j)),
slope AS (SELECT frame, j, i, v, sqrt(pow({_GRAD.format(k='i', n=6, h='(2.0/7)').replace('nxt', 'nx').replace('prv', 'px')}, 2) + pow({_GRAD.format(k='j', n=6, h='(2.0/7)').replace('nxt', 'ny').replace('prv', 'py')}, 2)) AS g FROM sn)"""


@query(f"WITH {a.STAG_SQL}, {_SLOPE} SELECT 'stag' AS case_id, round(median(g), 6) AS median, false AS any_nan FROM slope WHERE abs(v) < 0.25 * (2.0 / 7)")
def check_signed_distance(spark, d):
    return checks.interface_slope(a.stag(spark, d), band=0.25).withColumn("median", r6("median"))


def _literal_params(spark):
    phys = {"wall_temp_scale": 50.0, "bulk_temp": 58.0, "sat_temp": 57.0, "length_scale": 7e-4, "velocity_scale": 0.08, "time_scale": 0.01, "rho_liquid": 0.0, "odd": 1.0}
    nond = {n: 0.5 for n in ("gravx", "gravy", "gravz", "inv_reynolds", "inflow_velscale", "prandtl", "stefan", "tsat", "inv_weber", "cpgas", "mugas", "rhogas")}
    disc = {n: 1.0 for n in ("num_blocks_x", "num_blocks_y", "nx_block", "ny_block", "x_min", "x_max", "y_min", "y_max", "dt")}
    rows = [("a", g, 0, k, v, "number") for g, m in (("physical", phys), ("non_dimensional", nond), ("discretization", disc)) for k, v in m.items()]
    return spark.createDataFrame(rows, "case_id string, grp string, entry int, name string, value double, kind string")


@query("""SELECT 'a' AS case_id, severity, 'parameters' AS "check", message FROM (VALUES ('error', 'discretization is missing t_initial, needed for the grid'), ('error', 'non_dimensional is missing thcogas'),
('warning', 'physical is missing thco_liquid'), ('error', 'physical rho_liquid must be positive'), ('warning', 'physical parameters without a unit: odd'), ('error', 'wall_temp_scale is not above bulk_temp'),
('warning', 'bulk_temp is above sat_temp: the bulk is superheated'), ('warning', 'time_scale is not length_scale / velocity_scale')) t(severity, message)""")
def check_parameters(spark, d):
    return checks.check_parameters(_literal_params(spark))


@query("""SELECT case_id, heater, severity, 'heaters' AS "check", message FROM (VALUES ('a', 0, 'error', 'heater 0 is missing velContact'), ('a', 1, 'warning', 'heater 1 wall_temp does not match its fraction'), ('a', 1, 'error', 'heater 1 has no extent along x'),
('a', 1, 'warning', 'heater 1 has nucleation sites off it at 0.5, 3.0'), ('a', 2, 'error', 'heater 2 lies outside the domain along x'), ('b', -1, 'warning', 'the case has no heaters')) t(case_id, heater, severity, message)""")
def check_heaters(spark, d):
    keys = ["type", "xMin", "xMax", "yMin", "yMax", "zMin", "zMax", "advAngle", "rcdAngle", "velContact", "nucWaitTime", "wall_temp_fraction"]
    rows = [("a", 0, [k for k in keys if k != "velContact"], "constant_wall_temp", 0.0, 1.0, None, 1.0, [0.5]), ("a", 1, keys, "constant_wall_temp", 2.0, 1.0, 60.0, 1.0, [0.5, 3.0]), ("a", 2, keys, "constant_wall_temp", 5.0, 6.0, 70.0, 1.0, [5.5])]
    heaters = spark.createDataFrame(rows, "case_id string, heater int, keys array<string>, type string, xMin double, xMax double, wall_temp double, wall_temp_fraction double, nuc_sites_x array<double>")
    cases = spark.createDataFrame([("a", 0.0, 4.0, 58.0, 70.0), ("b", 0.0, 4.0, 58.0, 70.0)], "case_id string, x_min double, x_max double, bulk_temp double, wall_temp_scale double")
    return checks.check_heaters(cases, heaters).drop("k")


# --- stencils


@query(f"WITH {a.GRID_SQL}, n AS (SELECT *, lead(v) OVER (PARTITION BY case_id, frame, j ORDER BY i) AS nx FROM cells) SELECT case_id, frame, j, i, round(nx - v, 6) AS value FROM n WHERE nx IS NOT NULL")
def diff_x(spark, d):
    return out_cells(stencil.diff_x(a.grid(spark, d)), "case_id", "frame")


@query(f"WITH {a.GRID_SQL}, n AS (SELECT *, lead(v) OVER (PARTITION BY case_id, frame, i ORDER BY j) AS ny FROM cells) SELECT case_id, frame, j, i, round(ny - v, 6) AS value FROM n WHERE ny IS NOT NULL")
def diff_y(spark, d):
    return out_cells(stencil.diff_y(a.grid(spark, d)), "case_id", "frame")


_COORD = "list_transform(range(8), k -> 0.1 * k * k + k)"


def _uneven(rows):
    coords = F.array(*[F.lit(0.1 * k * k + k) for k in range(8)])
    return rows.withColumn("x", coords).withColumn("y", coords)


def _gradient_sql(axis: str, other: str) -> str:
    x = lambda k: f"(0.1 * ({k}) * ({k}) + ({k}))"
    p, q = f"({x(axis)} - {x(axis + ' - 1')})", f"({x(axis + ' + 1')} - {x(axis)})"
    return f"""WITH {a.GRID_SQL}, n AS (SELECT *, lead(v) OVER w AS nxt, lag(v) OVER w AS prv FROM cells WINDOW w AS (PARTITION BY case_id, frame, {other} ORDER BY {axis}))
SELECT case_id, frame, j, i, round(CASE WHEN prv IS NULL THEN (nxt - v) / {q} WHEN nxt IS NULL THEN (v - prv) / {p} ELSE -{q} / ({p} * ({p} + {q})) * prv + ({q} - {p}) / ({p} * {q}) * v + {p} / ({q} * ({p} + {q})) * nxt END, 6) AS value FROM n"""


@query(_gradient_sql("i", "j"))
def gradient_x(spark, d):
    return out_cells(stencil.gradient_x(_uneven(a.grid(spark, d))), "case_id", "frame")


@query(_gradient_sql("j", "i"))
def gradient_y(spark, d):
    return out_cells(stencil.gradient_y(_uneven(a.grid(spark, d))), "case_id", "frame")


_PAIR = f"""cx AS (SELECT *, lead(v) OVER w AS nxt, lag(v) OVER w AS prv FROM {{x}} WINDOW w AS (PARTITION BY frame, j ORDER BY i)), cy AS (SELECT *, lead(v) OVER w AS nxt, lag(v) OVER w AS prv FROM {{y}} WINDOW w AS (PARTITION BY frame, i ORDER BY j)),
gx AS (SELECT frame, j, i, {_GRAD.format(k='i', n=6, h='(2.0/7)')} AS g FROM cx), gy AS (SELECT frame, j, i, {_GRAD.format(k='j', n=6, h='(2.0/7)')} AS g FROM cy)"""


@query(f"WITH {a.STAG_SQL}, {_PAIR.format(x='cw', y='cu')} SELECT frame, j, i, round(gx.g - gy.g, 6) AS value FROM gx JOIN gy USING (frame, j, i)")
def vorticity(spark, d):
    return out_cells(stencil.vorticity(a.stag_cells(spark, d)), "frame")


@query(f"WITH {a.STAG_SQL} SELECT frame, j, i, round(v, 6) AS value FROM div")
def divergence_face(spark, d):
    rows = a.stag(spark, d)
    pairs = stencil.pair_fields(rows, "velfacex", "velfacey")
    faces = rows.select("case_id", "x_faces", "y_faces").limit(1)
    return out_cells(stencil.face_divergence(pairs.join(F.broadcast(faces), "case_id")), "frame")


@query(f"WITH {a.STAG_SQL}, {_PAIR.format(x='cu', y='cw')} SELECT frame, j, i, round(gx.g + gy.g, 6) AS value FROM gx JOIN gy USING (frame, j, i)")
def divergence_cell(spark, d):
    rows = a.stag_cells(spark, d)
    coords = rows.select("case_id", "x", "y").limit(1)
    return out_cells(stencil.cell_divergence(stencil.pair_fields(rows, "velx", "vely").join(F.broadcast(coords), "case_id")), "frame")


@query(f"""WITH {a.STAG_SQL} SELECT u.frame, u.j, u.i, round(sqrt(pow(0.5 * (u.v + u.nx), 2) + pow(0.5 * (w.v + w.ny), 2)), 6) AS value, round(sqrt(pow(u.v, 2) + pow(w.v, 2)), 6) AS cell_value
FROM u JOIN w ON w.frame = u.frame AND w.j = u.j AND w.i = u.i WHERE u.nx IS NOT NULL AND w.ny IS NOT NULL""")
def velocity_magnitude(spark, d):
    rows = a.stag_cells(spark, d)
    faces = out_cells(stencil.face_speed(stencil.pair_fields(rows, "velfacex", "velfacey")), "frame")
    cells = out_cells(stencil.cell_speed(stencil.pair_fields(rows, "velx", "vely")), "frame", name="cell_value")
    return faces.join(cells, ["frame", "j", "i"])


@query(f"WITH {a.STAG_SQL} SELECT frame, round(quantile_cont(abs(v), 0.99), 6) AS p FROM div GROUP BY frame")
def divergence_p99(spark, d):
    rows = a.stag(spark, d)
    faces = rows.select("case_id", "x_faces", "y_faces").limit(1)
    cells = statistics.cells(stencil.face_divergence(stencil.pair_fields(rows, "velfacex", "velfacey").join(F.broadcast(faces), "case_id")).select("frame", "j", "vals"))
    return stencil.percentile_or_one(cells, 0.99, "frame").withColumn("p", r6("p"))


@query(f"WITH {a.GRID_SQL} SELECT case_id, j, i, round(avg(v), 6) AS mean FROM cells GROUP BY ALL")
def temporal_mean(spark, d):
    return stencil.temporal_mean(a.grid(spark, d)).select("case_id", "j", "i", r6("mean").alias("mean"))


# --- physics


@query(f"WITH {a.STAG_SQL} SELECT frame, j, i, v < 0 AS liquid, abs(v) < 0.25 * (2.0 / 7) AS near, abs(v) > 0.25 * (2.0 / 7) AS away FROM s")
def interface_band(spark, d):
    cells = statistics.cells(a.stag(spark, d).where("field = 'dfun'").select("frame", "j", "vals"))
    return cells.select("frame", "j", "i", physics.is_liquid("value").alias("liquid"), physics.near_interface("value", 0.25, 2.0 / 7).alias("near"), physics.away_from_interface("value", 0.25, 2.0 / 7).alias("away"))


@query(f"""WITH {a.STAG_SQL} SELECT t.frame, t.i, round((t.i + 0.5) * 2 / 7, 6) AS x, round(CASE WHEN s.v < 0 THEN 0.05 ELSE 0.2 * 0.05 END * (70 - (58 + t.v * 12)) / ((2.5 * 2 / 7 - 0.6) * 0.001), 3) AS flux, s.v < 0 AS liquid
FROM th t JOIN s USING (frame, j, i) WHERE t.j = 2 AND (t.i + 0.5) * 2 / 7 BETWEEN 0.4 AND 1.6""")
def heat_flux(spark, d):
    rows = a.stag(spark, d)
    coords = rows.select("case_id", "x", "y").limit(1)
    heaters = spark.createDataFrame([("stag", 0, "constant_wall_temp", 0.4, 1.6, 0.6, 70.0, 58.0, 70.0, 0.001, 0.05, 0.2)], "case_id string, heater int, type string, xMin double, xMax double, yMax double, wall_temp double, bulk_temp double, wall_temp_scale double, length_scale double, thco_liquid double, thcogas double")
    flux = physics.heater_heat_flux(stencil.pair_fields(rows, "temperature", "dfun").join(F.broadcast(coords), "case_id"), heaters)
    return flux.select("frame", "i", r6("x").alias("x"), F.round("flux", 3).alias("flux"), "liquid")


# --- stacking


@query(f"""WITH {a.STAG_SQL} SELECT t.frame, t.j, t.i, [round(t.v, 6), round(u.v, 6), round(u.nx, 6), round(w.v, 6), round(w.ny, 6)] AS channels FROM th t JOIN u ON u.frame = t.frame AND u.j = t.j AND u.i = t.i JOIN w ON w.frame = t.frame AND w.j = t.j AND w.i = t.i""")
def stack_field_cells(spark, d):
    pairs = stencil.pair_fields(a.stag(spark, d), "temperature", "velfacex", "velfacey").withColumn("up", F.lead("velfacey").over(stencil.paired())).where("temperature IS NOT NULL")
    stacked = pairs.withColumn("vals", windows.stack_cells(["temperature"], ["velfacex"], [("velfacey", "up")]))
    return stacked.select("frame", F.col("j").cast("int").alias("j"), F.posexplode("vals").alias("i", "channels")).withColumn("channels", F.transform("channels", r6_signed))


@query(f"""WITH {a.STAG_SQL}, f AS (SELECT frame, j, 0 AS i, v AS x FROM cu WHERE i = 0 UNION ALL SELECT p.frame, p.j, p.i, 0.5 * (p.v + q.v) FROM cu p JOIN cw q ON q.frame = p.frame AND q.j = p.j AND q.i = p.i - 1
UNION ALL SELECT frame, j, 7, v FROM cw WHERE i = 6) SELECT frame, j, CAST(i AS INT) AS i, round(x, 6) AS value FROM f""")
def unstack_field_cells(spark, d):
    pairs = stencil.pair_fields(a.stag_cells(spark, d), "velx", "vely").where("velx IS NOT NULL")
    return out_cells(pairs.withColumn("vals", windows.unstack_faces("velx", "vely")), "frame")


# --- symmetry


@query(f"""WITH {a.STAG_SQL}, m AS (SELECT 'temperature' AS field, frame, j, 6 - i AS i, v FROM th UNION ALL SELECT 'temperature', frame, j, 7 + i, v FROM th) SELECT field, frame, j, CAST(i AS INT) AS i, round(v, 6) AS value FROM m""")
def mirror_field_x(spark, d):
    return out_cells(symmetry.mirror_rows(a.stag(spark, d).where("field = 'temperature'")), "field", "frame")


@query(f"""WITH {a.STAG_SQL}, m AS (SELECT frame, j, 7 - i AS i, -v AS v FROM u WHERE i > 0 UNION ALL SELECT frame, j, 7 + i, v FROM u) SELECT frame, j, CAST(i AS INT) AS i, round(v, 6) + 0.0 AS value FROM m""")
def mirror_face_x(spark, d):
    return out_cells(symmetry.mirror_rows(a.stag(spark, d).where("field = 'velfacex'"), x="x_faces"), "frame")


@query("SELECT 'a' AS case_id, [-0.7, -0.5, 0.0, 0.5, 0.7]::DOUBLE[] AS nuc_sites_x, [3.0, 2.0, 1.0, 2.0, 3.0]::DOUBLE[] AS nuc_sites_y, [0.25, 0.2, 0.15, 0.2, 0.25]::DOUBLE[] AS nuc_seed_radii")
def mirror_heaters(spark, d):
    h = spark.createDataFrame([("a", [0.0, 0.5, 0.7], [1.0, 2.0, 3.0], [0.15, 0.2, 0.25])], "case_id string, nuc_sites_x array<double>, nuc_sites_y array<double>, nuc_seed_radii array<double>")
    return symmetry.mirror_heaters(h).select("case_id", "nuc_sites_x", "nuc_sites_y", "nuc_seed_radii")


@query("SELECT 'a' AS case_id, -2.0::DOUBLE AS x_min, 2.0::DOUBLE AS x_max, 12 AS num_blocks_x, 'outflow_ins' AS left_type, 'outflow_ins' AS right_type, 0.0::DOUBLE AS mirrored_about_x")
def mirror_parameters(spark, d):
    p = spark.createDataFrame([("a", 0.0, 2.0, 6, "slip_ins", "outflow_ins")], "case_id string, x_min double, x_max double, num_blocks_x int, left_type string, right_type string")
    return symmetry.mirror_parameters(p)


@query(f"""WITH {a.STAG_SQL}, f AS (SELECT 'velfacex' AS field, frame, 6 - j AS j, 7 - i AS i, -v AS v FROM u UNION ALL SELECT 'velfacey', frame, 7 - j, 6 - i, -v FROM w UNION ALL SELECT 'temperature', frame, 6 - j, 6 - i, v FROM th)
SELECT field, frame, CAST(j AS INT) AS j, CAST(i AS INT) AS i, round(v, 6) + 0.0 AS value FROM f""")
def flip_fields(spark, d):
    rows = a.stag(spark, d).where("field <> 'dfun'").withColumn("ny", F.when(F.col("field") == "velfacey", 8).otherwise(7))
    return out_cells(symmetry.flip_rows(rows.withColumn("flip_x", F.lit(True)).withColumn("flip_y", F.lit(True))), "field", "frame")


@query("""SELECT case_id, flip, xMin::DOUBLE AS xMin, xMax::DOUBLE AS xMax, nuc_sites_x::DOUBLE[] AS nuc_sites_x, left_type, right_type FROM (VALUES ('a', true, 2.5, 3.5, [3.0], 'noslip_ins', 'slip_ins'), ('b', false, 0.5, 1.5, [1.0], 'slip_ins', 'noslip_ins')) t(case_id, flip, xMin, xMax, nuc_sites_x, left_type, right_type)""")
def reflect_config(spark, d):
    rows = spark.createDataFrame([("a", 0.0, -1.0, 0.0, 4.0, 0.5, 1.5, [1.0], "slip_ins", "noslip_ins"), ("b", -1.0, 0.0, 0.0, 4.0, 0.5, 1.5, [1.0], "slip_ins", "noslip_ins")], "case_id string, gravx double, gravy double, x_min double, x_max double, xMin double, xMax double, nuc_sites_x array<double>, left_type string, right_type string")
    rows = rows.toDF("case_id", "gravx", "gravy", "low", "high", "xMin", "xMax", "nuc_sites_x", "left_type", "right_type")
    flags = rows.withColumn("gravz", F.lit(0.0)).withColumn("flip", symmetry.flippable()["x"])
    return symmetry.swap_sides(symmetry.reflect_heaters(flags, "x", "low", "high", "flip"), "x", "flip").select("case_id", "flip", "xMin", "xMax", "nuc_sites_x", "left_type", "right_type")


# --- normalization

_FSTATS = "st AS (SELECT field, avg(value) AS m, stddev_pop(value) AS s FROM fields GROUP BY field)"


def _normalizer(spark, d, **options):
    """Over the fields' statistics alone; a configuration's are computed where one is normalized."""
    stats = statistics.value_statistics(a.fields(spark, d), "field")
    none = spark.createDataFrame([], "path string, count long, mean double, std double, min double, max double")
    return normalize.Normalizer.from_tables(stats, none, **options)


@query(f"WITH {a.FIELDS_SQL}, {_FSTATS} SELECT case_id, field, count(*) AS n, round(avg((value - m) / s), 5) AS mean, round(min((value - m) / s), 6) AS low, round(max((value - m) / s), 6) AS high FROM fields JOIN st USING (field) GROUP BY ALL")
def normalize_fields(spark, d):
    z = _normalizer(spark, d).normalize_fields(a.fields(spark, d))
    return z.groupBy("case_id", "field").agg(F.count("*").alias("n"), (F.round(F.avg("value"), 5) + F.lit(0.0)).alias("mean"), r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"))


@query(f"WITH {a.FIELDS_SQL} SELECT field, round(sum(value), 2) AS total, true AS close FROM fields GROUP BY field")
def normalize_round_trip(spark, d):
    n = _normalizer(spark, d)
    back = n.unnormalize_fields(n.normalize_fields(a.fields(spark, d).withColumn("original", F.col("value"))))
    return back.groupBy("field").agg(F.round(F.sum("value"), 2).alias("total"), F.bool_and(F.abs(F.col("value") - F.col("original")) <= 1e-9 * F.greatest(F.abs("original"), F.lit(1.0))).alias("close"))


@query(f"WITH {a.FIELDS_SQL}, {_FSTATS}, r AS (SELECT sqrt(avg(s * s + m * m)) AS rms FROM st WHERE field IN ('l_discount', 'l_tax')) SELECT field, round(max(value / rms), 6) AS high, round(min(rms), 6) AS rms FROM fields, r WHERE field IN ('l_discount', 'l_tax') GROUP BY field")
def normalize_vector_rms(spark, d):
    stats = statistics.value_statistics(a.fields(spark, d), "field")
    rms = statistics.vector_rms(stats, ["l_discount", "l_tax"])
    n = _normalizer(spark, d, vector_fields=[["l_discount", "l_tax"]])
    z = n.normalize_fields(a.fields(spark, d).where("field IN ('l_discount', 'l_tax')")).groupBy("field").agg(F.max("value").alias("high"))
    return z.crossJoin(F.broadcast(rms)).select("field", r6("high").alias("high"), r6("rms").alias("rms"))


@query("""WITH p AS (SELECT event_id AS case_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events WHERE props IS NOT NULL),
st AS (SELECT (min(v) + max(v)) / 2 AS o, CASE WHEN max(v) > min(v) THEN (max(v) - min(v)) / 2 ELSE 1 END AS h FROM p)
SELECT case_id, 'non_dimensional' AS grp, 0 AS entry, 'k' AS name, round((v - o) / h, 6) + 0.0 AS value FROM p, st
UNION ALL SELECT event_id, 'heaters', CAST(x AS INT), 'wall_temp_fraction', 2.0 * x - 1 FROM events, range(2) t(x) WHERE props IS NOT NULL
UNION ALL SELECT event_id, 'physical', 0, 'bulk_temp', 0.0 FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, 'discretization', 0, 'nx_block', 16.0 FROM events WHERE props IS NOT NULL""")
def normalize_config_minmax(spark, d):
    params = cfg.config_params(a.config_cases(spark, d))
    none = spark.createDataFrame([], "field string, count long, mean double, std double, min double, max double")
    z = normalize.Normalizer.from_tables(none, statistics.config_statistics(params)).normalize_config(params)
    return z.where("kind = 'number'").select("case_id", "grp", F.col("entry").cast("int").alias("entry"), "name", r6("value").alias("value"))


# --- configurations


@query("""SELECT event_id AS case_id, [CAST(58 AS FLOAT), CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) AS FLOAT), CAST(16 AS FLOAT)] AS features FROM events WHERE props IS NOT NULL""")
def config_matrix(spark, d):
    return cfg.config_matrix(cfg.config_params(a.config_cases(spark, d)), {"physical": ["bulk_temp"], "non_dimensional": ["k"], "discretization": ["nx_block"]})


@query("SELECT event_id AS case_id, unnest(['physical.wall_temp_scale', 'boundary.right.type']) AS path FROM events WHERE props IS NOT NULL")
def config_missing_keys(spark, d):
    return cfg.missing_keys(cfg.config_params(a.config_cases(spark, d)), {"physical": ["bulk_temp", "wall_temp_scale"], "boundary": ["left.type", "right.type"]})


# --- windows


@query(f"WITH {a.SERIES_SQL}, n AS (SELECT case_id, max(frame) + 1 AS n FROM series GROUP BY case_id), w AS (SELECT case_id, unnest(range(2, n - 10 + 1, 3)) AS start FROM n WHERE n - 2 - 10 >= 0) SELECT row_number() OVER (ORDER BY case_id, start) - 1 AS window_id, case_id, CAST(start AS INT) AS start FROM w")
def windows_index(spark, d):
    return windows.window_index(_series_cases(spark, d), 4, 3, unroll=2, stride=3, start=2)


def _series_cases(spark, d):
    cases = a.series(spark, d).groupBy("case_id").agg((F.max("frame") + 1).alias("num_frames"))
    return cases.withColumn("position", F.col("case_id"))


def _samples_sql(length: int, n_in: int, stride: int) -> str:
    return f"""WITH {a.SERIES_SQL}, n AS (SELECT case_id, max(frame) + 1 AS n FROM series GROUP BY case_id), w AS (SELECT case_id, unnest(range(0, n - {length} + 1, {stride})) AS start FROM n WHERE n >= {length}),
k AS (SELECT row_number() OVER (ORDER BY case_id, start) - 1 AS window_id, * FROM w)
SELECT window_id, k.case_id, list(round(value, 6) ORDER BY frame) FILTER (frame < start + {n_in}) AS input, list(round(value, 6) ORDER BY frame) FILTER (frame >= start + {n_in}) AS target FROM k JOIN series s ON s.case_id = k.case_id AND frame >= start AND frame < start + {length} GROUP BY window_id, k.case_id"""


def _samples(spark, d, n_in, n_target, unroll, stride):
    index = windows.window_index(_series_cases(spark, d), n_in, n_target, unroll, stride)
    values = a.series(spark, d).withColumn("value", r6_signed("value"))
    return windows.window_samples(index, values, n_in, n_target, unroll)


@query(_samples_sql(6, 4, 5))
def windows_samples(spark, d):
    return _samples(spark, d, 4, 2, 1, 5)


@query(_samples_sql(8, 2, 4))
def windows_unrolled(spark, d):
    return _samples(spark, d, 2, 2, 3, 4)


@query(f"SELECT window_id, input[1:2] AS first_two, (input || target)[3:] AS rolled FROM ({_samples_sql(6, 4, 5)})")
def window_head_tail_extend(spark, d):
    s = _samples(spark, d, 4, 2, 1, 5)
    return s.select("window_id", windows.head("input", 2).alias("first_two"), windows.last(windows.extend("input", "target"), 4).alias("rolled"))


# --- blocks


@query(f"WITH {a.GRID_SQL} SELECT case_id, frame, j, i, round(v, 6) AS value FROM cells")
def blocks_assemble(spark, d):
    rows = a.grid(spark, d)
    tiles = rows.select("case_id", "field", "frame", F.expr("cast(j div 4 as int)").alias("row"), F.expr("cast(j % 4 as int)").alias("jb"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.slice("vals", 4 * c + 1, 4).alias("line")) for c in (0, 1)])).alias("t"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("jb", "t.line"))), lambda s: s["line"])
    tiles = tiles.groupBy("case_id", "field", "frame", "row", F.col("t.col").alias("col")).agg(data.alias("data")).withColumn("n_rows", F.lit(2)).withColumn("n_cols", F.lit(2))
    return out_cells(blocks.assemble(tiles), "case_id", "frame")


# --- decomposition, splits, augmentation: no SQL counterpart


def _decomposed(spark, d):
    snaps = dmd.snapshot_rows(a.grid(spark, d), "case_id")
    return dmd.decompose_cases(dmd.without_mean(snaps), 1.0, 20)


@query()
def dmd_gram_spectrum(spark, d):
    found = _decomposed(spark, d).select("case_id", F.posexplode("singular_values").alias("k", "singular_value"))
    return found.withColumn("singular_value", r6("singular_value"))


@query()
def dmd_reconstruct_error(spark, d):
    return _decomposed(spark, d).select("case_id", "num_frames", "error")


@query()
def split_cases(spark, d):
    return split.split_cases(a.grid(spark, d).select("case_id").where("case_id IS NOT NULL"), [0.8, 0.1, 0.1], 7)


def _augmentable(spark, d):
    rows = a.stag(spark, d).withColumn("window_id", F.col("frame").cast("long")).withColumn("part", F.lit("input"))
    return rows.withColumn("ny", F.when(F.col("field") == "velfacey", 8).otherwise(7)).withColumn("gravx", F.lit(0.0)).withColumn("gravy", F.lit(-1.0)).withColumn("gravz", F.lit(0.0))


@query()
def augment_flip(spark, d):
    return out_cells(augment.flip_augmentation(_augmentable(spark, d), 0.5, seed=11), "window_id", "field")


@query()
def augment_noise(spark, d):
    return out_cells(augment.noise_augmentation(_augmentable(spark, d), 0.05, 0.2, seed=11), "window_id", "field")


@query(f"WITH {a.STAG_SQL} SELECT 'stag' AS case_id, field, (SELECT q FROM quarter) AS have, (SELECT q FROM quarter) + 1 AS want FROM (VALUES ('velfacex'), ('velfacey'), ('dfun'), ('temperature')) t(field)")
def frame_count_invariant(spark, d):
    rows = a.stag(spark, d)
    n = rows.select(F.max("frame")).first()[0]
    frames = spark.range(n + 2).select(F.lit("stag").alias("case_id"), F.col("id").alias("frame"))
    return grid.frame_counts(rows, frames)


@query("SELECT CAST(0.5 * (k + (k + 1)) AS DOUBLE) AS mid, CAST(k AS INT) AS i FROM range(4) t(k)")
def face_pair_average(spark, d):
    one = spark.range(1).select(F.array(*[F.lit(float(k)) for k in range(5)]).alias("v"))
    return one.select(F.posexplode(midpoints("v")).alias("i", "mid"))


from gridloom.plans import more  # noqa: E402, F401  registers its queries here
