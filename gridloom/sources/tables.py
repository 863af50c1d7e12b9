"""The canonical store: Parquet tables of cases, frames, grid and field lines, partitioned so that scans prune.

field_rows is partitioned by case_id and field and sorted by frame within files: a field projection prunes directories,
a frame range is pushed to the row groups. Writing checks first that every field lies on the described grid.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import infer_locations
from gridloom.operators.slicing import select_fields, slice_frames


def write_case_tables(path: str, field_rows: DataFrame, frames: DataFrame, grid: DataFrame, cases: DataFrame) -> None:
    """cases: (case_id, config string JSON, units string JSON)."""
    off = infer_locations(field_rows, grid).where("x_loc IS NULL OR y_loc IS NULL")
    if bad := off.select("case_id", "field").limit(5).collect():
        raise ValueError(f"fields off the described grid: {[tuple(r) for r in bad]}")
    field_rows.repartition("case_id", "field").sortWithinPartitions("case_id", "field", "frame", "j").write.partitionBy("case_id", "field").parquet(f"{path}/field_rows")
    frames.write.parquet(f"{path}/frames")
    grid.write.parquet(f"{path}/grid")
    counts = frames.groupBy("case_id").agg(F.count("*").cast("int").alias("num_frames"))
    cases.join(counts, "case_id", "left").write.parquet(f"{path}/cases")


def read_fields(spark: SparkSession, path: str, names: list[str] | None = None, frames: slice | None = None, num_frames: int | None = None) -> DataFrame:
    """Field lines; names and frames reach the scan."""
    rows = spark.read.parquet(f"{path}/field_rows")
    if names is not None:
        rows = select_fields(rows, names, field_names(spark, path))
    if frames is not None:
        rows = slice_frames(rows, frames, num_frames if num_frames is not None else num_timesteps(spark, path))
    return rows


def field_names(spark: SparkSession, path: str) -> list[str]:
    """Stored fields, sorted: partition values, no data read."""
    return sorted(r.field for r in spark.read.parquet(f"{path}/field_rows").select("field").distinct().collect())


def num_timesteps(spark: SparkSession, path: str) -> int:
    """The number of frames that all cases share."""
    found = [r.num_frames for r in spark.read.parquet(f"{path}/cases").select("num_frames").distinct().collect()]
    if len(found) != 1:
        raise ValueError(f"cases have {found} frames; slice them one by one")
    return found[0]


def read_parameters(spark: SparkSession, path: str, sidecar: DataFrame | None = None) -> DataFrame:
    """(case_id, config VARIANT): the embedded configuration, else a sidecar's (case_id, config) of the same stem; a case
    with neither is an error."""
    cases = spark.read.parquet(f"{path}/cases").select("case_id", "config")
    if sidecar is not None:
        cases = cases.join(sidecar.withColumnRenamed("config", "__side"), "case_id", "left").withColumn("config", F.coalesce("config", "__side")).drop("__side")
    text = F.when(F.col("config").isNotNull(), F.col("config")).otherwise(F.raise_error(F.concat(F.lit("no parameters for case "), F.col("case_id").cast("string"))))
    return cases.select("case_id", F.parse_json(text).alias("config"))


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, units map): empty where none were recorded."""
    kind = "map<string,map<string,string>>"
    cases = spark.read.parquet(f"{path}/cases")
    units = F.from_json("units", kind) if "units" in cases.columns else F.lit(None).cast(kind)
    return cases.select("case_id", F.coalesce(units, F.expr(f"cast(map() AS {kind})")).alias("units"))


def with_time(frames: DataFrame, stored: DataFrame, start: str = "t_initial", step: str = "dt") -> DataFrame:
    """Each frame's stored time, else start + step * frame. frames: (case_id, frame, start, step)."""
    return frames.join(stored.select("case_id", "frame", "time"), ["case_id", "frame"], "left").select("case_id", "frame", F.coalesce("time", F.col(start) + F.col(step) * F.col("frame")).alias("time"))


def statistics_json(fields: DataFrame, config: DataFrame) -> str:
    """Statistics tables (a row per field and path) as one JSON record, ending in a newline."""
    record = {"fields": {r.field: {k: r[k] for k in ("count", "mean", "std", "min", "max")} for r in fields.orderBy("field").collect()}, "config": {}}
    for r in config.orderBy("path").collect():
        group, name = r.path.split(".", 1)
        record["config"].setdefault(group, {})[name] = {k: r[k] for k in ("count", "mean", "std", "min", "max")}
    return json.dumps(record, indent=4) + "\n"


def read_statistics(text: str) -> tuple[dict, dict]:
    """(field statistics, config statistics by path) of a JSON record."""
    record = json.loads(text)
    if missing := sorted({"fields", "config"} - set(record)):
        raise ValueError(f"the statistics lack {missing}")
    return record["fields"], {f"{g}.{n}": s for g, names in record["config"].items() for n, s in names.items()}
