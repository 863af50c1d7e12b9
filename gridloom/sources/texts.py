"""Text and JSON side files: heater counts, physical parameters, split manifests, runtime-parameter tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.fixed import BOUNDARY_KEYS, GRAVITY, HEATER_COUNT_PATTERN, HEATER_PATTERN, NON_DIMENSIONAL, PLOTFILE_PATTERN


def decoded_table(names, values) -> Column:
    """Padded (name, value) records as a map, both trimmed."""
    return F.map_from_entries(F.zip_with(names, values, lambda k, v: F.struct(F.trim(k), F.trim(v))))


def heater_count(spark: SparkSession, path: str) -> DataFrame:
    """(path, heaters): the count in each flash.par, null where it names none."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    found = F.regexp_extract("value", HEATER_COUNT_PATTERN, 1)
    return text.select("path", F.when(found != "", found.cast("int")).alias("heaters"))


def heater_count_issues(found: DataFrame, stated: DataFrame) -> DataFrame:
    """Warnings where a case's heater files differ in number from its flash.par: (case_id, found), (case_id, stated)."""
    odd = found.join(stated, "case_id").where("stated IS NOT NULL AND found <> stated")
    return odd.select("case_id", F.lit("warning").alias("severity"), F.lit("heaters").alias("check"), F.format_string("%d heater files, but %d in flash.par", "found", "stated").alias("message"))


def physical_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(path, physical map): the Physical group of parameters.json; bulk_temp defaults to sat_temp, wall_temp is the scale."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "Physical map<string,string>").alias("p"))
    own = F.coalesce("p.Physical", F.expr("cast(map() AS map<string,string>)"))
    known = text.select("path", own.alias("m"))
    bulk = F.when(F.map_contains_key("m", F.lit("bulk_temp")) | ~F.map_contains_key("m", F.lit("sat_temp")), F.col("m")).otherwise(F.map_concat("m", F.create_map(F.lit("bulk_temp"), F.col("m")["sat_temp"])))
    filled = known.withColumn("m", bulk)
    others = F.map_filter("m", lambda k, _: ~k.isin("wall_temp", "wall_temp_scale"))
    scale = F.when(F.map_contains_key("m", F.lit("wall_temp")), F.map_concat(others, F.create_map(F.lit("wall_temp_scale"), F.col("m")["wall_temp"]))).otherwise(F.col("m"))
    return filled.select("path", scale.alias("physical"))


def non_dimensional(runtime: DataFrame) -> DataFrame:
    """(case_id, name, value) from runtime parameters (case_id, name, value): renamed, gravity 0 where it isn't set."""
    names = runtime.sparkSession.createDataFrame(list(NON_DIMENSIONAL.items()), "name string, renamed string")
    have = runtime.join(F.broadcast(names), "name").select("case_id", F.col("renamed").alias("name"), F.col("value").cast("double").alias("value"))
    gravity = runtime.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.lit(g) for g in GRAVITY])).alias("name"))
    absent = gravity.join(have, ["case_id", "name"], "left_anti").select("case_id", "name", F.lit(0.0).alias("value"))
    return have.unionByName(absent)


def boundary_types(runtime: DataFrame) -> DataFrame:
    """(case_id, side, type) from the runtime parameters."""
    sides = runtime.sparkSession.createDataFrame([(key, side) for side, key in BOUNDARY_KEYS.items()], "name string, side string")
    return runtime.join(F.broadcast(sides), "name").select("case_id", "side", F.trim("value").alias("type"))


def discretization(runtime: DataFrame, layout: DataFrame) -> DataFrame:
    """One row a case from runtime parameters (case_id, name, value) and block places (case_id, block, x_low, ..., n_rows)
    with the cells of a block (nx_block, ny_block)."""
    at = lambda n, kind: F.max(F.when(F.col("name") == n, F.trim("value"))).cast(kind)
    stated = runtime.groupBy("case_id").agg(at("geometry", "string").alias("geometry"), at("plotfileintervaltime", "double").alias("dt"), at("tinitial", "double").alias("t_initial"), at("tmax", "double").alias("t_final"))
    box = layout.groupBy("case_id").agg(
        F.max("n_cols").alias("num_blocks_x"), F.max("n_rows").alias("num_blocks_y"), F.max("nx_block").alias("nx_block"), F.max("ny_block").alias("ny_block"),
        F.min("x_low").alias("x_min"), F.max("x_high").alias("x_max"), F.min("y_low").alias("y_min"), F.max("y_high").alias("y_max"),
    )
    return stated.join(box, "case_id")


def case_folders(folder: str, prefix: str = "") -> list[str]:
    """Case directories under a folder, sorted; none is an error."""
    found = sorted(e.path for e in os.scandir(folder) if e.is_dir() and e.name.startswith(prefix))
    if not found:
        raise FileNotFoundError(f"no case directories {prefix}* in {folder}")
    return found


def listed_files(paths: DataFrame, kind: str = "plot") -> DataFrame:
    """(path, frame): the files of a kind by the end of their names, numbered in name order."""
    picked = paths.where(F.col("path").rlike(PLOTFILE_PATTERN if kind == "plot" else HEATER_PATTERN))
    return picked.select("path", (F.row_number().over(_by_path()) - 1).alias("frame"))


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy(F.regexp_replace("path", r"/[^/]*$", "")).orderBy("path")


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split, case_id) of split.json files."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("split", "names")).select("split", F.explode("names").alias("case_id"))
