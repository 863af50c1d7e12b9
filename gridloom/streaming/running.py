"""Beyond the batch operators: statistics kept up to date as new cases land, and rollout state.

Moments merge by Chan's rule as columns, so a micro-batch's record and the stored one join by field and combine; the
stored table is written anew under a version folder, so a retried batch is harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.statistics import field_statistics


def merge_records(old: DataFrame, new: DataFrame, key: str = "field") -> DataFrame:
    """Statistics of the union of two disjoint sets from their statistics."""
    a, b = old.select(key, *[F.col(c).alias(f"a_{c}") for c in ("count", "mean", "std", "min", "max")]), new.select(key, *[F.col(c).alias(f"b_{c}") for c in ("count", "mean", "std", "min", "max")])
    j = a.join(b, key, "full_outer")
    na, nb = F.coalesce("a_count", F.lit(0)), F.coalesce("b_count", F.lit(0))
    n, delta = na + nb, F.coalesce("b_mean", F.lit(0.0)) - F.coalesce("a_mean", F.lit(0.0))
    mean = (na * F.coalesce("a_mean", F.lit(0.0)) + nb * F.coalesce("b_mean", F.lit(0.0))) / n
    m2 = na * F.pow(F.coalesce("a_std", F.lit(0.0)), F.lit(2)) + nb * F.pow(F.coalesce("b_std", F.lit(0.0)), F.lit(2)) + F.when((na > 0) & (nb > 0), delta * delta * na * nb / n).otherwise(0.0)
    return j.select(key, n.cast("long").alias("count"), mean.alias("mean"), F.sqrt(m2 / n).alias("std"), F.least("a_min", "b_min").alias("min"), F.greatest("a_max", "b_max").alias("max"))


def keep_statistics(stream: DataFrame, store: str, checkpoint: str):
    """A streaming query that folds each micro-batch of field lines into the records under `store`/v=<batch>."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = field_statistics(batch)
        merged = merge_records(spark.read.parquet(f"{store}/v={number - 1}"), fresh) if number else fresh
        merged.write.mode("overwrite").parquet(f"{store}/v={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, store: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{store}/v={number}")


def rollout_step(history: DataFrame, predicted: DataFrame, n: int) -> DataFrame:
    """(key, frames): a prediction's frames join the history, of which the last n stay."""
    from gridloom.operators.windows import extend, last

    return history.join(predicted.withColumnRenamed("frames", "more"), "window_id").select("window_id", last(extend("frames", "more"), n).alias("frames"))
