"""Views that present the driver's tables as gridded cases. A test harness: the values are no physics.

GRID    each embedding is an 8 x 8 frame, its label the case, frames by vec_id
STAG    a quarter of the embeddings each for x faces (7 x 8), y faces (8 x 7), signed distance and temperature (7 x 7)
SERIES  each user's events by time: frames with a time and a value
FIELDS  numeric columns of lineitem as fields, l_returnflag the case
CFG     the props of events as configuration trees
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import linspace, midpoints

FIELDS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(embedding, height: int, width: int) -> Column:
    return F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda j: F.transform(F.slice(embedding, j * 8 + 1, F.lit(width)), lambda v: v.cast("double")))).alias("j", "vals")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """field_rows of GRID."""
    frame = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("frame")
    e = _read(spark, d, "embeddings").select(F.col("label").alias("case_id"), frame, "embedding")
    return e.select("case_id", F.lit("temperature").alias("field"), "frame", _lines(F.col("embedding"), 8, 8))


def stag(spark: SparkSession, d: str) -> DataFrame:
    """field_rows of STAG with x, y (centres) and x_faces, y_faces."""
    e = _read(spark, d, "embeddings")
    q = e.count() // 4
    parts = []
    for part, (name, height, width) in enumerate((("velfacex", 7, 8), ("velfacey", 8, 7), ("dfun", 7, 7), ("temperature", 7, 7))):
        own = e.where((F.col("vec_id") >= part * q) & (F.col("vec_id") < (part + 1) * q))
        parts.append(own.select(F.lit("stag").alias("case_id"), F.lit(name).alias("field"), (F.col("vec_id") - part * q).cast("int").alias("frame"), _lines(F.col("embedding"), height, width)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    faces = linspace(0.0, 2.0, 7)
    return rows.select("*", midpoints(faces).alias("x"), midpoints(faces).alias("y"), faces.alias("x_faces"), faces.alias("y_faces"))


def stag_cells(spark: SparkSession, d: str) -> DataFrame:
    """STAG with velx, vely: the 7 x 7 crops of the face fields."""
    rows = stag(spark, d)
    crop = rows.where("field IN ('velfacex', 'velfacey') AND j < 7").withColumn("vals", F.slice("vals", 1, 7)).withColumn("field", F.expr("CASE field WHEN 'velfacex' THEN 'velx' ELSE 'vely' END"))
    return rows.unionByName(crop)


def series(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, frame, time, value) of SERIES."""
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return _read(spark, d, "events").select(F.col("user_id").alias("case_id"), frame, (micros / F.lit(1e6)).alias("time"), F.col("value").cast("double").alias("value"))


def fields(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, field, value) of FIELDS."""
    l = _read(spark, d, "lineitem").select(F.col("l_returnflag").alias("case_id"), *[F.col(c).cast("double").alias(c) for c in FIELDS])  # noqa: E741
    return l.unpivot(["case_id"], list(FIELDS), "field", "value")


def config_cases(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, config VARIANT): props under non_dimensional, with fixed parameters of every kind around them."""
    e = _read(spark, d, "events")
    text = F.concat(F.lit('{"physical":{"fluid":"FC-72","bulk_temp":58,"flag":true},"non_dimensional":'), F.col("props"), F.lit(',"discretization":{"nx_block":16},"heaters":[{"wall_temp_fraction":0.5,"nuc_sites_x":[0.1,0.2]},{"wall_temp_fraction":1.0}],"boundary":{"left":{"type":"slip_ins"}}}'))
    return e.where("props IS NOT NULL").select(F.col("event_id").alias("case_id"), F.parse_json(text).alias("config"))


# The same views for DuckDB.
GRID_SQL = """grid AS (SELECT label AS case_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame, embedding FROM embeddings),
cells AS (SELECT case_id, frame, CAST(k // 8 AS INT) AS j, CAST(k % 8 AS INT) AS i, CAST(embedding[k + 1] AS DOUBLE) AS v FROM grid, range(64) t(k))"""
STAG_SQL = """quarter AS (SELECT count(*) // 4 AS q FROM embeddings),
parts AS (SELECT CAST(vec_id % q AS INT) AS frame, vec_id // q AS part, embedding FROM embeddings, quarter WHERE vec_id < 4 * q),
every AS MATERIALIZED (SELECT frame, part, CAST(k // 8 AS INT) AS j, CAST(k % 8 AS INT) AS i, CAST(embedding[k + 1] AS DOUBLE) AS v FROM parts, range(64) t(k)),
u AS MATERIALIZED (SELECT frame, j, i, v, lead(v) OVER (PARTITION BY frame, j ORDER BY i) AS nx FROM every WHERE part = 0 AND j < 7),
w AS MATERIALIZED (SELECT frame, j, i, v, lead(v) OVER (PARTITION BY frame, i ORDER BY j) AS ny FROM every WHERE part = 1 AND i < 7),
s AS (SELECT frame, j, i, v FROM every WHERE part = 2 AND j < 7 AND i < 7),
th AS (SELECT frame, j, i, v FROM every WHERE part = 3 AND j < 7 AND i < 7),
cu AS (SELECT frame, j, i, v FROM u WHERE i < 7),
cw AS (SELECT frame, j, i, v FROM w WHERE j < 7),
div AS (SELECT u.frame, u.j, u.i, (u.nx - u.v) / (2.0 / 7) + (w.ny - w.v) / (2.0 / 7) AS v FROM u JOIN w ON w.frame = u.frame AND w.j = u.j AND w.i = u.i WHERE u.nx IS NOT NULL AND w.ny IS NOT NULL)"""
SERIES_SQL = "series AS (SELECT user_id AS case_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame, epoch_us(ts) / 1e6 AS time, CAST(value AS DOUBLE) AS value FROM events)"
FIELDS_SQL = "fields AS (SELECT l_returnflag AS case_id, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS field, unnest([l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[]) AS value FROM lineitem)"
