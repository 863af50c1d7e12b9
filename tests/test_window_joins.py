"""Unnested windows are many rows made of few: their joins never broadcast them, however small Spark takes them for."""

from pyspark.sql import functions as F

from gridloom.operators import windows


def ran(df):
    """The rows and the final plan."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return rows, plan.split("== Initial Plan ==")[0]


def test_windows_of_long_cases_are_not_broadcast(spark):
    cases = spark.createDataFrame([(k, k, 500) for k in range(3)], "case_id long, position long, num_frames int")
    frames = spark.range(1500).select((F.col("id") % 3).alias("case_id"), F.floor(F.col("id") / 3).cast("int").alias("frame"), F.col("id").cast("double").alias("value"))
    index = windows.window_index(cases, 2, 2, 3, 4)
    rows, plan = ran(windows.window_samples(index, frames, 2, 2, 3))
    assert len(rows) == 3 * ((500 - 8) // 4 + 1) and all((len(r.input), len(r.target)) == (2, 6) for r in rows)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    lines = frames.select("case_id", F.lit("temperature").alias("field"), "frame", F.lit(0).alias("j"), F.array("value").alias("vals"))
    rows, plan = ran(windows.window_rows(index, lines, 2, 2, 3))
    assert len(rows) == 8 * 3 * ((500 - 8) // 4 + 1)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_configurations_meet_samples_without_assembling_them_twice(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from gridloom.plans import catalogue, more  # noqa: F401

    n = 4000
    pq.write_table(pa.table({"event_id": range(n), "ts": pa.array([k * 10**6 for k in range(n)], pa.timestamp("us")), "user_id": [k % 2 for k in range(n)], "value": [0.5] * n}), tmp_path / "events.parquet")
    rows, plan = ran(catalogue.queries()["samples_with_config"](spark, str(tmp_path)))
    assert sorted(map(tuple, rows)) == [(k, 40 + k // 399) for k in range(2 * 399)]  # (2000 - 6) // 5 + 1 windows a case
    assert sum("Generate explode" in line and "[offset#" in line for line in plan.splitlines()) == 1
