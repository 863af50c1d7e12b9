"""Registered queries over stores and side files written to a scratch folder, and over tables as dumps and samples."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.api import Cases
from gridloom.functions import config as cfg
from gridloom.functions.fixed import HEATER_SHARED_KEYS, SPLITS
from gridloom.operators import augment, blocks, checks, dmd, grid, normalize, slicing, split, statistics, stencil, symmetry, windows
from gridloom.plans import adapters as a
from gridloom.plans.catalogue import _REC, _record, _samples, _samples_sql, _series_cases, _stag_grid, out_cells, query, r6, r6_signed
from gridloom.session import scratch_dir, ship_package
from gridloom.sources import tables, texts

# --- the store

_CONFIG = '{"physical":{"bulk_temp":58,"wall_temp_scale":70},"non_dimensional":{"gravy":-1},"discretization":{"num_blocks_x":1,"nx_block":8,"x_min":0,"x_max":2},"heaters":[{"type":"constant_wall_temp","xMin":0,"xMax":1,"wall_temp_fraction":1,"nuc_sites_x":[0.5]}],"boundary":{"left":{"type":"slip_ins"},"right":{"type":"outflow_ins"}}}'


def _cells_grid(spark, cases):
    disc = cases.select("case_id", F.lit(0.0).alias("x_min"), F.lit(2.0).alias("x_max"), F.lit(1).alias("num_blocks_x"), F.lit(8).alias("nx_block"), F.lit(0.0).alias("y_min"), F.lit(2.0).alias("y_max"), F.lit(1).alias("num_blocks_y"), F.lit(8).alias("ny_block"))
    return grid.build_grid(disc)


def _store(spark, d, config=_CONFIG):
    """GRID as a store of temperature and its negative; cases with an odd label have no units, those divisible by 3 no parameters."""
    rows = a.grid(spark, d)
    rows = rows.unionByName(rows.withColumn("field", F.lit("pressure")).withColumn("vals", F.transform("vals", lambda v: -v)))
    cases = rows.select("case_id").distinct()
    frames = rows.select("case_id", "frame").distinct().withColumn("time", F.col("frame") * F.lit(0.5))
    path = scratch_dir(spark)
    described = cases.select("case_id", F.when(F.col("case_id") % 3 != 0, F.lit(config)).alias("config"), F.when(F.col("case_id") % 2 == 0, F.lit('{"physical":{"bulk_temp":"degC"}}')).alias("units"))
    tables.write_case_tables(path, rows, frames, _cells_grid(spark, cases), described)
    return path


@query(f"WITH {a.GRID_SQL} SELECT case_id, 'pressure' AS field, frame, j, i, round(-v, 6) + 0.0 AS value FROM cells WHERE frame BETWEEN 2 AND 4")
def store_read_fields(spark, d):
    return out_cells(tables.read_fields(spark, _store(spark, d), ["pressure"], slice(2, 5), num_frames=100), "case_id", "field", "frame")


@query(f"WITH {a.GRID_SQL} SELECT case_id, CAST(max(frame) + 1 AS INT) AS num_frames FROM grid GROUP BY case_id")
def store_num_frames(spark, d):
    return spark.read.parquet(f"{_store(spark, d)}/cases").select("case_id", "num_frames")


@query("SELECT * FROM (VALUES ('pressure', 0), ('temperature', 1)) t(field, place)")
def store_field_names(spark, d):
    return spark.createDataFrame([(n, k) for k, n in enumerate(tables.field_names(spark, _store(spark, d)))], "field string, place int")


@query("SELECT DISTINCT label AS case_id, CASE WHEN label % 2 = 0 THEN 'degC' END AS bulk_temp FROM embeddings")
def store_units(spark, d):
    return tables.read_units(spark, _store(spark, d)).select("case_id", F.col("units")["physical"]["bulk_temp"].alias("bulk_temp"))


@query("SELECT DISTINCT label AS case_id, CAST(CASE WHEN label % 3 = 0 THEN 40 + label ELSE 58 END AS DOUBLE) AS bulk_temp FROM embeddings")
def store_parameters_sidecar(spark, d):
    path = _store(spark, d)
    side = spark.read.parquet(f"{path}/cases").select("case_id", F.concat(F.lit('{"physical":{"bulk_temp":'), F.col("case_id") + 40, F.lit("}}")).alias("config"))
    params = cfg.config_params(tables.read_parameters(spark, path, side))
    return params.where("grp = 'physical' AND name = 'bulk_temp'").select("case_id", F.col("value").alias("bulk_temp"))


def _whole_store(spark, d):
    """The store with parameters for every case."""
    path = _store(spark, d)
    cases = spark.read.parquet(f"{path}/cases").withColumn("config", F.lit(_CONFIG))
    cases.write.parquet(f"{path}/whole/cases")
    for name in ("field_rows", "frames", "grid"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{path}/whole/{name}")
    return f"{path}/whole"


@query(f"WITH {a.GRID_SQL}, m AS (SELECT case_id, frame, j, 7 - i AS i, v FROM cells UNION ALL SELECT case_id, frame, j, 8 + i, v FROM cells) SELECT case_id, frame, j, CAST(i AS INT) AS i, round(v, 6) AS value FROM m WHERE frame < 3")
def facade_mirrored_read(spark, d):
    found = Cases.from_tables(spark, _whole_store(spark, d), ["temperature"], mirror=True)
    return out_cells(slicing.slice_frames(found.rows, slice(0, 3), 100), "case_id", "frame")


@query("SELECT DISTINCT label AS case_id, CAST(-2 AS DOUBLE) AS x_min, CAST(2 AS DOUBLE) AS num_blocks_x, 'outflow_ins' AS left_type, [-0.5, 0.5]::DOUBLE[] AS nuc_sites_x FROM embeddings")
def facade_mirrored_case(spark, d):
    found = Cases.from_tables(spark, _whole_store(spark, d), mirror=True)
    at = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
    return found.params.groupBy("case_id").agg(at("x_min"), at("num_blocks_x")).join(found.sides.select("case_id", "left_type"), "case_id").join(found.heaters.select("case_id", "nuc_sites_x"), "case_id")


@query("""SELECT DISTINCT label AS case_id, 'heaters' AS "check", 'error' AS severity, 'heater 0 is missing yMin, yMax, zMin, zMax, advAngle, rcdAngle, velContact, nucWaitTime' AS message FROM embeddings""")
def facade_heater_check(spark, d):
    return Cases.from_tables(spark, _whole_store(spark, d)).check().where("check = 'heaters'").select("case_id", "check", "severity", "message")


@query("SELECT 1 AS exit_code")
def check_exit_code(spark, d):
    return spark.createDataFrame([(checks.exit_code(Cases.from_tables(spark, _whole_store(spark, d)).check()),)], "exit_code int")


@query(f"WITH {a.GRID_SQL}, signed AS (SELECT 'temperature' AS field, v FROM cells UNION ALL SELECT 'pressure', -v FROM cells) SELECT field, {_REC} FROM signed GROUP BY field")
def statistics_json_round_trip(spark, d):
    cases = Cases.from_tables(spark, _whole_store(spark, d))
    fields, _ = tables.read_statistics(tables.statistics_json(*cases.statistics()))
    return _record(spark.createDataFrame([(n, *(s[c] for c in statistics.RECORD)) for n, s in fields.items()], "field string, count long, mean double, std double, min double, max double"), "field")


@query(f"WITH {a.GRID_SQL}, n AS (SELECT count(DISTINCT case_id) AS c FROM cells) SELECT path, c AS count, CAST(v AS DOUBLE) AS mean FROM n, (VALUES ('physical.bulk_temp', 58.0), ('physical.wall_temp_scale', 70.0), ('non_dimensional.gravy', -1.0), ('discretization.num_blocks_x', 1.0), ('discretization.nx_block', 8.0), ('discretization.x_min', 0.0), ('discretization.x_max', 2.0), ('heaters.xMin', 0.0), ('heaters.xMax', 1.0), ('heaters.wall_temp_fraction', 1.0)) t(path, v)")
def file_config_statistics(spark, d):
    config = tables.read_parameters(spark, _whole_store(spark, d))
    return statistics.config_statistics(cfg.config_params(config)).select("path", "count", "mean")


@query("SELECT DISTINCT label AS case_id, [CAST(1 AS FLOAT), CAST(70 AS FLOAT)] AS features FROM embeddings")
def config_one_heater(spark, d):
    params = cfg.config_params(tables.read_parameters(spark, _whole_store(spark, d)))
    return cfg.config_matrix(params, {"heaters": ["wall_temp_fraction"], "physical": ["wall_temp_scale"]})


# --- side files


def _texts(rows, column):
    """rows' text column as one text file a folder k=<key>."""
    path = scratch_dir(rows.sparkSession)
    rows.select(F.col(column).alias("value"), "k").repartition("k").write.partitionBy("k").text(path)
    return f"{path}/*/*.txt"


def _key(df):
    return df.withColumn("k", F.regexp_extract("path", "k=([0-9]+)", 1).cast("int")).drop("path")


@query("SELECT r_regionkey AS k, CASE WHEN r_regionkey > 0 THEN r_regionkey + 2 END AS heaters FROM region")
def heater_count_files(spark, d):
    par = F.when(F.col("r_regionkey") > 0, F.concat(F.lit("run = 1\n  HTR_numHeaters = "), F.col("r_regionkey") + 2, F.lit("\nend"))).otherwise(F.lit("nothing"))
    return _key(texts.heater_count(spark, _texts(spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("k"), par.alias("t")), "t")))


@query("SELECT r_regionkey AS case_id, 'warning' AS severity, 'heaters' AS \"check\", '3 heater files, but ' || r_regionkey || ' in flash.par' AS message FROM region WHERE r_regionkey NOT IN (0, 3)")
def heater_count_differs(spark, d):
    region = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("case_id"))
    return texts.heater_count_issues(region.withColumn("found", F.lit(3)), region.withColumn("stated", F.when(F.col("case_id") > 0, F.col("case_id"))))


@query("SELECT r_regionkey AS k, '57' AS bulk_temp, CAST(60 + r_regionkey AS VARCHAR) AS wall_temp_scale FROM region")
def physical_parameter_files(spark, d):
    t = F.concat(F.lit('{"Heater":{"n":1},"Physical":{"sat_temp":57,"wall_temp":'), F.col("r_regionkey") + 60, F.lit("}}"))
    found = _key(texts.physical_parameters(spark, _texts(spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("k"), t.alias("t")), "t")))
    return found.select("k", F.col("physical")["bulk_temp"].alias("bulk_temp"), F.col("physical")["wall_temp_scale"].alias("wall_temp_scale"))


_SIZES = "sizes AS (SELECT n, greatest(1, CAST(floor(0.1 * n) AS BIGINT)) AS v FROM total)"


@query(f"WITH total AS (SELECT count(DISTINCT c_custkey) AS n FROM customer), {_SIZES} SELECT 'train' AS split, n - 2 * v AS cases FROM sizes UNION ALL SELECT 'val', v FROM sizes UNION ALL SELECT 'test', v FROM sizes")
def split_manifest_sizes(spark, d):
    cases = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("case_id"))
    path = scratch_dir(spark)
    found = split.manifest(split.split_cases(cases, [0.8, 0.1, 0.1], 5))
    spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.text(path)
    return split.leading_share(texts.split_manifest(spark, path).distinct())


@query("WITH total AS (SELECT count(DISTINCT label) AS n FROM embeddings), sizes AS (SELECT n, greatest(1, CAST(floor(0.3 * n) AS BIGINT)) AS v FROM total) SELECT label AS case_id, 'once' AS seen FROM (SELECT DISTINCT label FROM embeddings)")
def split_covers_cases(spark, d):
    found = split.split_cases(a.grid(spark, d).select("case_id"), [0.4, 0.3, 0.3], 2)
    return found.where(F.col("split").isin(list(SPLITS))).groupBy("case_id").agg(F.when(F.count("*") == 1, "once").otherwise("several").alias("seen"))


@query("WITH p AS (SELECT user_id, '/d/case-' || user_id || '/run_hdf5_' || ['plt_cnt', 'htr', 'chk'][event_id % 3 + 1] || '_' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS path, event_id FROM events) SELECT path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY path) - 1 AS INT) AS frame FROM p WHERE event_id % 3 = 0")
def plot_file_listing(spark, d):
    return texts.listed_files(_paths(spark, d))


@query("WITH p AS (SELECT user_id, '/d/case-' || user_id || '/run_hdf5_htr_' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS path FROM events WHERE event_id % 3 = 1) SELECT path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY path) - 1 AS INT) AS frame FROM p")
def heater_file_listing(spark, d):
    return texts.listed_files(_paths(spark, d), "heater")


def _paths(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("plt_cnt", "htr", "chk"))), (F.col("event_id") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("/d/case-"), "user_id", F.lit("/run_hdf5_"), kind, F.lit("_"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("path"))


@query("SELECT c_custkey AS case_id, trim(unnest([' ' || c_name || '  ', 'segment '])) AS name, trim(unnest([CAST(c_nationkey AS VARCHAR) || ' ', '  ' || c_mktsegment])) AS value FROM customer")
def decoded_tables(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    names, values = F.array(F.concat(F.lit(" "), "c_name", F.lit("  ")), F.lit("segment ")), F.array(F.concat(F.col("c_nationkey").cast("string"), F.lit(" ")), F.concat(F.lit("  "), "c_mktsegment"))
    return c.select(F.col("c_custkey").alias("case_id"), F.explode(texts.decoded_table(names, values)).alias("name", "value"))


def _runtime(spark, d):
    """Each customer as a run: its runtime parameters (case_id, name, value)."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    pairs = {"ht_prandtl": F.col("c_acctbal").cast("string"), "ins_gravy": F.lit("-1.0"), "xl_boundary_type": F.concat("c_mktsegment", F.lit("  ")), "yr_boundary_type": F.lit(" outflow_ins"), "geometry": F.lit("cartesian "), "plotfileintervaltime": F.lit("0.5"), "tinitial": F.col("c_nationkey").cast("string"), "tmax": F.lit("100")}
    entries = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in pairs.items()])
    return c.select(F.col("c_custkey").alias("case_id"), F.explode(entries).alias("e")).select("case_id", "e.*")


@query("SELECT c_custkey AS case_id, unnest(['prandtl', 'gravx', 'gravy', 'gravz']) AS name, unnest([c_acctbal, 0.0, -1.0, 0.0]::DOUBLE[]) AS value FROM customer")
def non_dimensional_read(spark, d):
    return texts.non_dimensional(_runtime(spark, d))


@query("SELECT c_custkey AS case_id, unnest(['left', 'top']) AS side, unnest([c_mktsegment, 'outflow_ins']) AS type FROM customer")
def boundary_read(spark, d):
    return texts.boundary_types(_runtime(spark, d))


def _layout(spark, d):
    """Each customer's run of 2 x 3 blocks, numbered from the top right."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("case_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("block"))
    col, row = 1 - F.col("block") % 2, 2 - F.floor(F.col("block") / 2)
    return c.select("case_id", "block", F.lit(1).alias("level"), F.lit(2).alias("dimensionality"), (col * 1.5).alias("x_low"), (col * 1.5 + 1.5).alias("x_high"), (row * 0.5).alias("y_low"), (row * 0.5 + 0.5).alias("y_high"), F.lit(2).alias("n_cols"), F.lit(3).alias("n_rows"))


@query("SELECT c_custkey AS case_id, CAST(b AS INT) AS block, CAST(2 - b // 2 AS INT) AS \"row\", CAST(1 - b % 2 AS INT) AS col, CAST((2 - b // 2) * 2 + 1 - b % 2 AS INT) AS place FROM customer, range(6) t(b)")
def block_layout(spark, d):
    return blocks.block_places(_layout(spark, d)).select("case_id", "block", "row", "col", "place")


@query("SELECT c_custkey AS case_id, 'cartesian' AS geometry, CAST(0.5 AS DOUBLE) AS dt, CAST(c_nationkey AS DOUBLE) AS t_initial, CAST(100 AS DOUBLE) AS t_final, 2 AS num_blocks_x, 3 AS num_blocks_y, CAST(3 AS DOUBLE) AS x_max, CAST(1.5 AS DOUBLE) AS y_max FROM customer")
def discretization_read(spark, d):
    found = texts.discretization(_runtime(spark, d), _layout(spark, d).withColumn("nx_block", F.lit(16)).withColumn("ny_block", F.lit(16)))
    return found.select("case_id", "geometry", "dt", "t_initial", "t_final", "num_blocks_x", "num_blocks_y", "x_max", "y_max")


@query("SELECT CASE event_id % 6 WHEN 0 THEN 'temperature' WHEN 1 THEN 'pressure' WHEN 2 THEN 'velfacex' WHEN 3 THEN 'dfun' WHEN 4 THEN 'massflux' ELSE 'normy' END AS field, count(*) AS n FROM events GROUP BY 1")
def renamed_variables(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("temp", "pres", "fv_x", "dfun", "mflx ", "nrmy"))), (F.col("event_id") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").groupBy(blocks.renamed(name).alias("field")).agg(F.count("*").alias("n"))


@query(f"WITH {a.GRID_SQL} SELECT case_id, frame, j, i, round(v, 6) AS value FROM cells WHERE i < 7")
def blocks_assemble_x_faces(spark, d):
    rows = a.grid(spark, d).withColumn("field", F.lit("velfacex")).withColumn("vals", F.slice("vals", 1, 7))
    cut = F.array(*[F.struct(F.lit(c).alias("col"), F.slice("vals", 3 * c + 1, 4).alias("line")) for c in (0, 1)])
    wide = rows.select("case_id", "field", "frame", F.expr("cast(j div 4 as int)").alias("row"), F.expr("cast(j % 4 as int)").alias("jb"), F.explode(cut).alias("t"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("jb", "t.line"))), lambda s: s["line"])
    tiles = wide.groupBy("case_id", "field", "frame", "row", F.col("t.col").alias("col")).agg(data.alias("data")).withColumn("n_rows", F.lit(2)).withColumn("n_cols", F.lit(2))
    return out_cells(blocks.assemble(tiles), "case_id", "frame")


@query(f"WITH {a.GRID_SQL} SELECT case_id, frame, j, i, round(v, 6) AS value FROM cells WHERE j < 7")
def blocks_assemble_y_faces(spark, d):
    rows = a.grid(spark, d).withColumn("field", F.lit("velfacey")).where("j < 7")
    wide = rows.select("case_id", "field", "frame", "j", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.slice("vals", 4 * c + 1, 4).alias("line")) for c in (0, 1)])).alias("t"))
    both = wide.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("row")).withColumn("jb", F.col("j") - 3 * F.col("row")).where("jb BETWEEN 0 AND 3")
    data = F.transform(F.array_sort(F.collect_list(F.struct("jb", "t.line"))), lambda s: s["line"])
    tiles = both.groupBy("case_id", "field", "frame", "row", F.col("t.col").alias("col")).agg(data.alias("data")).withColumn("n_rows", F.lit(2)).withColumn("n_cols", F.lit(2))
    return out_cells(blocks.assemble(tiles), "case_id", "frame")


@query(f"WITH {a.GRID_SQL} SELECT DISTINCT case_id, frame, 'pressure' AS field FROM cells WHERE frame % 5 = 2")
def incomplete_frames(spark, d):
    rows = a.grid(spark, d).select("case_id", "frame", "field").distinct()
    return blocks.incomplete_frames(rows.unionByName(rows.withColumn("field", F.lit("pressure")).where("frame % 5 <> 2")))


# --- samples


@query(f"SELECT window_id, 40 + case_id % 7 AS bulk_temp FROM ({_samples_sql(6, 4, 5)})")
def samples_with_config(spark, d):
    s = _samples(spark, d, 4, 2, 1, 5)
    config = _series_cases(spark, d).select("case_id", (F.col("case_id") % 7 + 40).alias("bulk_temp"))
    return s.join(config, "case_id").select("window_id", "bulk_temp")


def _windowed(spark, d):
    cases = a.grid(spark, d).groupBy("case_id").agg((F.max("frame") + 1).alias("num_frames")).withColumn("position", F.col("case_id"))
    return windows.window_rows(windows.window_index(cases, 2, 1, stride=4), a.grid(spark, d), 2, 1)


_WINDOWED = f"""{a.GRID_SQL}, n AS (SELECT case_id, max(frame) + 1 AS n FROM grid GROUP BY case_id), w AS (SELECT case_id, unnest(range(0, n - 2, 4)) AS start FROM n WHERE n >= 3),
k AS (SELECT row_number() OVER (ORDER BY case_id, start) - 1 AS window_id, * FROM w),
lines AS (SELECT window_id, CASE WHEN frame - start < 2 THEN 'input' ELSE 'target' END AS part, CASE WHEN frame - start < 2 THEN frame - start ELSE frame - start - 2 END AS frame, j, i, v FROM k JOIN cells c ON c.case_id = k.case_id AND c.frame >= start AND c.frame < start + 3)"""


@query(f"WITH {_WINDOWED} SELECT window_id, CAST(frame AS INT) AS frame, j, i, round(v, 6) AS value FROM lines WHERE part = 'input'")
def samples_as_cases(spark, d):
    found = windows.case_rows(_windowed(spark, d)).withColumnRenamed("case_id", "window_id")
    return out_cells(found.withColumn("frame", F.col("frame").cast("int")), "window_id", "frame")


@query(f"WITH {_WINDOWED} SELECT DISTINCT window_id, 'fields differ in their number of frames' AS problem FROM lines WHERE window_id % 3 = 1")
def batch_frame_counts(spark, d):
    rows = _windowed(spark, d).where("part = 'input'")
    return windows.batch_invariants(rows.unionByName(rows.withColumn("field", F.lit("pressure")).where("NOT (window_id % 3 = 1 AND frame = 1)")))


@query(f"WITH {a.GRID_SQL} SELECT CAST(case_id % 2 AS INT) AS sample, frame, j, i, round(v, 6) AS value FROM cells WHERE case_id < 2")
def collate_samples(spark, d):
    rows = a.grid(spark, d)
    one = lambda k: rows.where(F.col("case_id") == k).select("frame", "j", "vals")
    batch, _ = windows.collate_pairs([(one(0), one(0)), (one(1), one(1))])
    return out_cells(batch, "sample", "frame")


@query(f"WITH {_WINDOWED} SELECT window_id, part, count(*) AS n, round(sum(abs(v)), 4) AS size, round(max(abs(v)), 6) AS most FROM lines GROUP BY ALL")
def flips_keep_cells(spark, d):
    rows = _windowed(spark, d).withColumns({"ny": F.lit(8), "gravx": F.lit(0.0), "gravy": F.lit(-1.0), "gravz": F.lit(0.0)})
    v = F.abs(F.col("value"))
    return statistics.cells(augment.flip_augmentation(rows, 0.5, seed=3)).groupBy("window_id", "part").agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("size"), r6(F.max(v)).alias("most"))


@query(f"WITH {_WINDOWED} SELECT window_id, part, count(*) AS n, part = 'target' AS unchanged FROM lines GROUP BY ALL")
def noise_spares_targets(spark, d):
    rows = _windowed(spark, d).withColumns({"ny": F.lit(8), "gravx": F.lit(0.0), "gravy": F.lit(-1.0), "gravz": F.lit(0.0), "before": F.col("vals")})
    noisy = augment.compose(rows, [lambda r: augment.noise_augmentation(r, 0.05, 0.2, seed=4)])
    cells = noisy.select("window_id", "part", F.explode(F.arrays_zip("vals", "before")).alias("c"))
    return cells.groupBy("window_id", "part").agg(F.count("*").alias("n"), F.bool_and(F.col("c.vals") == F.col("c.before")).alias("unchanged"))


@query(f"WITH {a.GRID_SQL}, f(size, face) AS (VALUES (8, false), (9, true)) SELECT DISTINCT case_id, face, CAST(2.0 / 8 AS FLOAT) AS spacing FROM grid, f")
def sample_spacings(spark, d):
    rows = a.grid(spark, d).select("case_id").distinct().select("case_id", F.lit(0.0).alias("low"), F.lit(2.0).alias("high"), F.explode(F.array(F.struct(F.lit(8).alias("size"), F.lit(False).alias("face")), F.struct(F.lit(9).alias("size"), F.lit(True).alias("face")))).alias("s")).select("case_id", "low", "high", "s.*")
    return rows.select("case_id", "face", grid.sample_spacing("low", "high", "size", "face").alias("spacing"))


# --- physics, parameters, normalization, decomposition


@query("SELECT c_custkey AS case_id, round(20 + c_acctbal / 10000 * (c_nationkey + 50 - 20), 6) AS wall_temp FROM customer")
def heater_wall_temps(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("case_id"), (F.col("c_acctbal") / 10000).alias("f"), F.lit(20.0).alias("bulk"), (F.col("c_nationkey") + 50.0).alias("scale"))
    return c.select("case_id", r6(cfg.heater_wall_temp("f", "bulk", "scale")).alias("wall_temp"))


@query("""SELECT n_nationkey AS case_id, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['physical', 'heaters', 'heaters'] ELSE ['heaters', 'heaters'] END) AS grp, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['length_scale', 'wall_temp', 'heat_flux'] ELSE ['wall_temp', 'heat_flux'] END) AS name,
unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['m', 'degC', 'W/m^2'] ELSE ['degC', 'W/m^2'] END) AS unit FROM nation""")
def parameter_units(spark, d):
    keys = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("length_scale"), F.lit("fluid"))).otherwise(F.array(F.lit("fluid")))
    found = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("case_id"), F.explode(cfg.units(keys)).alias("grp", "m"))
    return found.select("case_id", "grp", F.explode("m").alias("name", "unit"))


@query(f"WITH {a.GRID_SQL} SELECT case_id, field, frame, round(sum(v), 5) + 0.0 AS total FROM (SELECT case_id, frame, 'temperature' AS field, v + 1 AS v FROM cells UNION ALL SELECT case_id, frame, 'pressure', -v FROM cells) GROUP BY ALL")
def field_replacement(spark, d):
    rows = a.grid(spark, d)
    rows = rows.unionByName(rows.withColumn("field", F.lit("pressure")).withColumn("vals", F.transform("vals", lambda v: -v)))
    changed = rows.withColumn("vals", F.when(F.col("field") == "temperature", F.transform("vals", lambda v: v + 1)).otherwise(F.col("vals")))
    return statistics.cells(changed).groupBy("case_id", "field", "frame").agg((F.round(F.sum("value"), 5) + F.lit(0.0)).alias("total"))


@query(f"WITH {a.STAG_SQL}, n AS (SELECT max(frame) + 1 AS n FROM th) SELECT j, i, round(v, 6) AS value FROM th, n WHERE frame = n - 3")
def frame_from_the_end(spark, d):
    rows = a.stag(spark, d)
    n = rows.agg(F.max("frame")).first()[0] + 1
    wanted = slicing.needed_fields(["temperature"], {"vorticity": ("velx", "vely")})
    return out_cells(slicing.time_slice(slicing.select_fields(rows, wanted), slicing.resolve_frame(-3, n)))


@query(f"WITH {a.FIELDS_SQL} SELECT field, count(*) AS n, round(sum(2 * value - m), 3) AS total FROM fields JOIN (SELECT field, avg(value) AS m FROM fields GROUP BY field) USING (field) GROUP BY field")
def normalize_forward(spark, d):
    rows = a.fields(spark, d).select("field", "value")
    stats = statistics.value_statistics(a.fields(spark, d), "field")
    none = spark.createDataFrame([], "path string, count long, mean double, std double, min double, max double")
    restored = normalize.Normalizer.from_json(normalize.Normalizer.from_tables(stats, none).to_json())

    def double(batches):
        for b in batches:
            yield b.set_column(b.schema.get_field_index("value"), "value", pa.compute.multiply(b.column("value"), 2.0))

    ship_package(spark)
    return restored.forward(rows, double, "field string, value double").groupBy("field").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(f"WITH {a.GRID_SQL}, m AS (SELECT case_id, j, i, avg(v) AS m FROM cells GROUP BY ALL), n AS (SELECT case_id, max(frame) AS last FROM grid GROUP BY case_id) SELECT case_id, round(sum((v - m) * (v - m)), 4) AS energy FROM cells JOIN m USING (case_id, j, i) JOIN n USING (case_id) WHERE frame < last GROUP BY case_id")
def dmd_energy(spark, d):
    snaps = dmd.without_mean(dmd.snapshot_rows(a.grid(spark, d), "case_id"))
    found = dmd.decompose_cases(snaps, 1.0, 20)
    return found.where("num_frames > 1").select("case_id", F.round(F.aggregate("singular_values", F.lit(0.0), lambda t, v: t + v * v), 4).alias("energy"))


@query(f"WITH {a.GRID_SQL} SELECT round(sqrt(sum(pow(0.1 * v, 2))) / sqrt(sum(v * v)), 6) AS error FROM cells WHERE case_id = (SELECT min(case_id) FROM cells)")
def relative_frobenius_error(spark, d):
    rows = a.grid(spark, d)
    snaps = dmd.snapshot_rows(rows.where(F.col("case_id") == rows.agg(F.min("case_id")).first()[0]))
    made = snaps.select("j", "i", F.transform("x", lambda v: v * 0.9).alias("x"))
    return dmd.relative_error(made, snaps).select(r6("error").alias("error"))


@query(f"WITH {a.STAG_SQL} SELECT t.frame, t.j, t.i, [round(t.v, 6), round(p.v, 6)] AS channels FROM th t JOIN s p USING (frame, j, i)")
def stack_cell_fields(spark, d):
    pairs = stencil.pair_fields(a.stag(spark, d), "temperature", "dfun").withColumn("vals", windows.stack_cells(["temperature", "dfun"]))
    return pairs.select("frame", F.col("j").cast("int").alias("j"), F.posexplode("vals").alias("i", "channels")).withColumn("channels", F.transform("channels", r6_signed))


@query("""SELECT o_custkey AS case_id, o_orderkey AS heater, [-x, x]::DOUBLE[] AS nuc_sites_x FROM (SELECT *, o_totalprice / 1000 AS x FROM orders)""")
def mirror_heaters_table(spark, d):
    h = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("heater"), F.array(F.col("o_totalprice") / 1000).alias("nuc_sites_x"))
    return symmetry.mirror_heaters(h)


@query("SELECT c_custkey AS case_id, axis, round(CASE axis WHEN 'x' THEN (c_nationkey + 1) / 4.0 ELSE (c_nationkey + 2) / 8.0 END, 6) AS spacing FROM customer, (VALUES ('x'), ('y')) t(axis)")
def grid_spacing_table(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("case_id"), F.lit(0.0).alias("x_min"), (F.col("c_nationkey") + 1.0).alias("x_max"), F.lit(1).alias("num_blocks_x"), F.lit(4).alias("nx_block"), F.lit(0.0).alias("y_min"), (F.col("c_nationkey") + 2.0).alias("y_max"), F.lit(2).alias("num_blocks_y"), F.lit(4).alias("ny_block"))
    return grid.spacings(grid.build_grid(c)).withColumn("spacing", r6("spacing"))


@query("SELECT c_custkey AS case_id, 'x' AS axis, 'dfun' AS field, c_nationkey % 2 = 0 AS on_grid FROM customer")
def on_grid_table(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    disc = c.select(F.col("c_custkey").alias("case_id"), F.lit(0.0).alias("x_min"), F.lit(4.0).alias("x_max"), F.lit(1).alias("num_blocks_x"), F.lit(4).alias("nx_block"), F.lit(0.0).alias("y_min"), F.lit(4.0).alias("y_max"), F.lit(1).alias("num_blocks_y"), F.lit(4).alias("ny_block"))
    off = F.when(F.col("c_nationkey") % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.01))
    coords = c.select(F.col("c_custkey").alias("case_id"), F.lit("dfun").alias("field"), F.lit("x").alias("axis"), F.array(*[F.lit(k + 0.5) + off for k in range(4)]).alias("coords"))
    return grid.on_grid(coords, grid.build_grid(disc))


@query("""SELECT c_custkey AS case_id, 'error' AS severity, 'parameters' AS "check", 'physical length_scale must be positive' AS message FROM customer WHERE c_acctbal <= 0
UNION ALL SELECT c_custkey, 'warning', 'parameters', 'bulk_temp is above sat_temp: the bulk is superheated' FROM customer WHERE c_nationkey > 12
UNION ALL SELECT c_custkey, 'error', 'parameters', 'wall_temp_scale is not above bulk_temp' FROM customer WHERE c_nationkey >= 20""")
def check_parameters_table(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    pairs = {"length_scale": F.col("c_acctbal"), "bulk_temp": F.col("c_nationkey").cast("double"), "sat_temp": F.lit(12.0), "wall_temp_scale": F.lit(20.0)}
    p = c.select(F.col("c_custkey").alias("case_id"), F.lit("physical").alias("grp"), F.lit(0).alias("entry"), F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in pairs.items()])).alias("e"), F.lit("number").alias("kind")).select("case_id", "grp", "entry", "e.*", "kind")
    return checks.check_parameters(p).where("NOT message LIKE '%missing%'")


@query(f"WITH {a.GRID_SQL}, n AS (SELECT *, lead(v) OVER (PARTITION BY case_id, frame, j ORDER BY i) AS nx FROM cells) SELECT case_id, frame, j, i, round(0.5 * (v + nx), 6) + 0.0 AS value FROM n WHERE nx IS NOT NULL")
def face_pair_average_table(spark, d):
    return out_cells(stencil.average_x(a.grid(spark, d)), "case_id", "frame")


def _runs(spark, d):
    """Each customer's grid: 2 blocks of 4 cells over [0, nation + 1] by 1 of 4 over [-1, 1]."""
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("case_id"), F.lit(0.0).alias("x_min"), (F.col("c_nationkey") + 1.0).alias("x_max"), F.lit(2).alias("num_blocks_x"), F.lit(4).alias("nx_block"), F.lit(-1.0).alias("y_min"), F.lit(1.0).alias("y_max"), F.lit(1).alias("num_blocks_y"), F.lit(4).alias("ny_block"))


@query("""WITH c AS (SELECT c_custkey AS case_id, 'x' AS axis, 0.0::DOUBLE AS lo, c_nationkey + 1.0::DOUBLE AS hi, 8 AS n FROM customer UNION ALL SELECT c_custkey, 'y', -1.0, 1.0, 4 FROM customer)
SELECT case_id, axis, 'faces' AS loc, CAST(k AS INT) AS i, round(lo + k * (hi - lo) / n, 6) AS coord FROM c, range(9) t(k) WHERE k <= n
UNION ALL SELECT case_id, axis, 'centers', CAST(k AS INT), round(lo + (k + 0.5) * (hi - lo) / n, 6) FROM c, range(8) t(k) WHERE k < n""")
def grid_faces_centers_table(spark, d):
    return grid.build_grid(_runs(spark, d)).select("case_id", "axis", "loc", F.posexplode("coords").alias("i", "coord")).withColumn("coord", r6("coord"))


@query("SELECT c_custkey AS case_id, -(c_nationkey + 1.0)::DOUBLE AS x_min, (c_nationkey + 1.0)::DOUBLE AS x_max, 4 AS num_blocks_x, 'outflow_ins' AS left_type, 'outflow_ins' AS right_type, 0.0::DOUBLE AS mirrored_about_x FROM customer")
def mirror_parameters_table(spark, d):
    rows = _runs(spark, d).select("case_id", "x_min", "x_max", "num_blocks_x", F.lit("slip_ins").alias("left_type"), F.lit("outflow_ins").alias("right_type"))
    return symmetry.mirror_parameters(rows)


@query("""SELECT c_custkey AS case_id, c_nationkey % 2 = 0 AS flip, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey + 1.0 - 0.75 ELSE 0.5 END::DOUBLE AS xMin, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey + 1.0 - 0.5 ELSE 0.75 END::DOUBLE AS xMax,
[CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey + 1.0 - 0.625 ELSE 0.625 END]::DOUBLE[] AS nuc_sites_x, CASE WHEN c_nationkey % 2 = 0 THEN 'noslip_ins' ELSE 'slip_ins' END AS left_type FROM customer""")
def reflect_config_table(spark, d):
    rows = _runs(spark, d).select("case_id", "x_min", "x_max", F.lit(0.5).alias("xMin"), F.lit(0.75).alias("xMax"), F.array(F.lit(0.625)).alias("nuc_sites_x"), F.lit("slip_ins").alias("left_type"), F.lit("noslip_ins").alias("right_type"))
    gravity = F.when(F.col("x_max").cast("int") % 2 == 1, 0.0).otherwise(-1.0)  # along x, or along y
    flags = rows.withColumns({"gravx": gravity, "gravy": -1.0 - gravity, "gravz": F.lit(0.0)}).withColumn("flip", symmetry.flippable()["x"])
    return symmetry.swap_sides(symmetry.reflect_heaters(flags, "x", "x_min", "x_max", "flip"), "x", "flip").select("case_id", "flip", "xMin", "xMax", "nuc_sites_x", "left_type")


@query("""SELECT c_custkey AS case_id, 0 AS heater, 'error' AS severity, 'heaters' AS "check", 'heater 0 lies outside the domain along x' AS message FROM customer WHERE c_nationkey < 10
UNION ALL SELECT c_custkey, 0, 'warning', 'heaters', 'heater 0 has nucleation sites off it at 9.5' FROM customer WHERE c_nationkey % 3 = 0""")
def check_heaters_table(spark, d):
    runs = _runs(spark, d)
    nation = F.col("x_max").cast("int") - 1
    cases = runs.select("case_id", "x_min", "x_max", F.lit(58.0).alias("bulk_temp"), F.lit(70.0).alias("wall_temp_scale"))
    keys = F.array(*map(F.lit, (*HEATER_SHARED_KEYS, "wall_temp_fraction")))
    heaters = runs.select("case_id", F.lit(0).alias("heater"), keys.alias("keys"), F.lit("constant_wall_temp").alias("type"), F.lit(10.0).alias("xMin"), F.lit(12.0).alias("xMax"), F.lit(70.0).alias("wall_temp"), F.lit(1.0).alias("wall_temp_fraction"), F.array(F.when(nation % 3 == 0, 9.5).otherwise(11.0)).alias("nuc_sites_x"))
    return checks.check_heaters(cases, heaters).drop("k")
