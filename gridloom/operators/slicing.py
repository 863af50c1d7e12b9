"""Field and frame selection: filters that reach the scan (field partitions are pruned, frame ranges pushed down)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_fields(rows: DataFrame, names: list[str], available: list[str] | None = None) -> DataFrame:
    """The rows of the named fields; a name outside `available` is an error at once."""
    if available is not None and (missing := sorted(set(names) - set(available))):
        raise KeyError(f"no fields {missing}; there are {sorted(available)}")
    return rows.where(F.col("field").isin(list(names)))


def slice_frames(rows: DataFrame, frames: slice, num_frames: int | None = None, renumber: bool = False) -> DataFrame:
    """The frames of a Python slice. With num_frames (a case's count) negative and absent bounds are resolved on the
    driver and the range is pushed down; without it, each case's `num_frames` column resolves them by row."""
    if num_frames is not None:
        start, stop, step = frames.indices(num_frames)
        if step < 0:
            raise ValueError("frames are read forwards")
        picked = rows.where((F.col("frame") >= start) & (F.col("frame") < stop) & ((F.col("frame") - start) % step == 0))
        return picked.withColumn("frame", F.expr(f"cast((frame - {start}) / {step} as int)")) if renumber else picked
    n, step = F.col("num_frames"), frames.step or 1
    bound = lambda v, default: default if v is None else F.greatest(n + v, F.lit(0)) if v < 0 else F.least(F.lit(v), n)
    start, stop = bound(frames.start, F.lit(0)), bound(frames.stop, n)
    picked = rows.where((F.col("frame") >= start) & (F.col("frame") < stop) & ((F.col("frame") - start) % step == 0))
    return picked.withColumn("frame", ((F.col("frame") - start) / step).cast("int")) if renumber else picked


def time_slice(rows: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Frames [start, stop), one frame if stop is absent; the grid stays."""
    return rows.where((F.col("frame") >= start) & (F.col("frame") < (start + 1 if stop is None else stop)))


def drop_ends(rows: DataFrame) -> DataFrame:
    """Without each case's first and last frame (of its num_frames), numbered anew."""
    return rows.where((F.col("frame") >= 1) & (F.col("frame") <= F.col("num_frames") - 2)).withColumn("frame", F.col("frame") - 1).withColumn("num_frames", F.col("num_frames") - 2)


def with_num_frames(rows: DataFrame) -> DataFrame:
    """num_frames of each case beside its rows."""
    counts = rows.groupBy("case_id").agg((F.max("frame") + 1).cast("int").alias("num_frames"))
    return rows.join(counts, "case_id")


def resolve_frame(index: int, num_frames: int) -> int:
    """An index that may count from the end, as a viewer takes it."""
    if not -num_frames <= index < num_frames:
        raise IndexError(f"frame {index} is outside the {num_frames} frames")
    return index % num_frames


def existing_fields(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows of the requested (case_id, field) pairs that are stored."""
    return rows.join(requested, ["case_id", "field"], "left_semi")


def needed_fields(targets: list[str], derived: dict[str, tuple[str, ...]]) -> list[str]:
    """Stored fields that the targets need, each once, in order; a derived target stands for its inputs."""
    return list(dict.fromkeys(f for t in targets for f in derived.get(t, (t,))))


def unstored(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested pairs that no row has."""
    return requested.join(rows.select("case_id", "field").distinct(), ["case_id", "field"], "left_anti")
