"""Dataset statistics: mergeable moments of fields and of configuration leaves.

Catalyst's count, avg, stddev_pop, min and max merge partial states as the chunk-wise rule does, so one aggregation
over any number of files is the whole operator: each task sends one row a group. Deviation: a NaN makes mean and std
NaN, while min and max are over the other values (the chunk-wise rule makes them depend on the chunking).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import col

RECORD = ("count", "mean", "std", "min", "max")


def moments(value) -> list[Column]:
    """The aggregates of a statistics record: count, mean, population std, min and max."""
    v = col(value).cast("double")
    known = F.when(~F.isnan(v), v)
    return [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(known).alias("min"), F.max(known).alias("max")]


def value_statistics(values: DataFrame, *by: str, value: str = "value") -> DataFrame:
    return values.groupBy(*by).agg(*moments(value))


def cells(rows: DataFrame) -> DataFrame:
    """Grid lines -> one row per cell: (..., j, i, value)."""
    keep = [c for c in rows.columns if c != "vals"]
    return rows.select(*keep, F.posexplode("vals").alias("i", "value"))


def field_statistics(rows: DataFrame, *by: str) -> DataFrame:
    """A record for each field over all frames, points and cases; lines are unnested only within tasks."""
    return value_statistics(rows.select(*(by or ("field",)), F.explode("vals").alias("value")), *(by or ("field",)))


def common_fields(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields of every case, fields of some cases only), each one column `field`."""
    pairs = rows.select("case_id", "field").distinct()
    total = pairs.agg(F.countDistinct("case_id").alias("cases"))
    held = pairs.groupBy("field").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return held.where("n = cases").select("field"), held.where("n < cases").select("field")


def config_statistics(params: DataFrame) -> DataFrame:
    """A record for each numeric configuration path; entries of a list of records are pooled, absent keys not counted."""
    numbers = params.where("kind = 'number'")
    return value_statistics(numbers.withColumn("path", F.concat_ws(".", "grp", "name")), "path")


def require_data(stats: DataFrame) -> DataFrame:
    """stats, failing where a group has no values (a population std of nothing has no meaning)."""
    return stats.withColumn("count", F.when(F.col("count") > 0, F.col("count")).otherwise(F.raise_error(F.lit("statistics of no values")).cast("long")))


def vector_rms(stats: DataFrame, components: list[str]) -> DataFrame:
    """One row `rms`: the root mean square of several components from their means and stds, 1 if zero."""
    square = F.avg(F.pow("std", F.lit(2.0)) + F.pow("mean", F.lit(2.0)))
    return stats.where(F.col("field").isin(components)).agg(square.alias("s")).select(F.when(F.col("s") > 0, F.sqrt("s")).otherwise(F.lit(1.0)).alias("rms"))
