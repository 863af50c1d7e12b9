"""Forecast windows, sample assembly, batches, stacking on cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import col, init, tail


def window_length(n_input: int, n_target: int, unroll: int = 1) -> int:
    return n_input + unroll * n_target


def validate_windows(n_input: int, n_target: int, unroll: int = 1, stride: int = 1, start: int = 0) -> None:
    for name, v in (("input", n_input), ("target", n_target), ("unroll", unroll), ("stride", stride)):
        if v < 1:
            raise ValueError(f"{name} must be positive, not {v}")
    if start < 0:
        raise ValueError(f"start must not be negative, not {start}")


def window_index(cases: DataFrame, n_input: int, n_target: int, unroll: int = 1, stride: int = 1, start: int = 0) -> DataFrame:
    """(window_id, case_id, start): windows of (case_id, position, num_frames), numbered in case position order.

    A case shorter than a window gives none. The number is a prefix sum over the cases (one row a case, no global sort of
    windows) plus the place within the case."""
    validate_windows(n_input, n_target, unroll, stride, start)
    length = window_length(n_input, n_target, unroll)
    count = F.greatest(F.floor((F.col("num_frames") - start - length) / F.lit(stride)) + 1, F.lit(0)).cast("long")
    counted = cases.withColumn("n", F.when(F.col("num_frames") - start - length >= 0, count).otherwise(F.lit(0).cast("long")))
    before = F.sum("n").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    ranked = counted.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).where("n > 0")
    exploded = ranked.select("case_id", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    return exploded.select((F.col("before") + F.col("k")).alias("window_id"), "case_id", (F.lit(start) + F.col("k") * stride).cast("int").alias("start"))


def window_frames(windows: DataFrame, n_input: int, n_target: int, unroll: int = 1) -> DataFrame:
    """(window_id, case_id, start, offset, frame, part): windows unnested, so that frames meet them by equality."""
    length = window_length(n_input, n_target, unroll)
    return windows.select("*", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("offset")).withColumn("frame", F.col("start") + F.col("offset")).withColumn("part", F.when(F.col("offset") < n_input, "input").otherwise("target"))


def _met(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of (case_id, frame, ...) at the frames of windows. Both sides shuffle: Spark takes an unnested table for as small
    as it was before, one row a case here, and would broadcast it at any size."""
    return frames.hint("merge").join(rows, ["case_id", "frame"])


def window_samples(windows: DataFrame, values: DataFrame, n_input: int, n_target: int, unroll: int = 1) -> DataFrame:
    """(window_id, case_id, input, target): each window's frames of (case_id, frame, value), in order."""
    joined = _met(window_frames(windows, n_input, n_target, unroll), values)
    ordered = lambda part: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("offset", "value")))), lambda s: s["value"])
    return joined.groupBy("window_id", "case_id").agg(ordered("input").alias("input"), ordered("target").alias("target"))


def window_rows(windows: DataFrame, rows: DataFrame, n_input: int, n_target: int, unroll: int = 1) -> DataFrame:
    """Field lines of every window: (window_id, part, field, frame as offset in its part, j, vals)."""
    at = window_frames(windows, n_input, n_target, unroll)
    out = _met(at, rows)
    return out.withColumn("frame", F.when(F.col("part") == "input", F.col("offset")).otherwise(F.col("offset") - n_input)).drop("offset", "start")


def case_rows(samples: DataFrame, part: str = "input") -> DataFrame:
    """The inverse for one part of window_rows: its lines as cases named by their windows. Normalized lines are an error,
    as a case's values are in its own units."""
    from gridloom.operators.normalize import State

    if State.of(samples, "vals"):
        raise ValueError("normalized samples are no cases: unnormalize them first")
    return samples.where(F.col("part") == part).select(F.col("window_id").alias("case_id"), "field", "frame", "j", "vals")


def window_at(windows: DataFrame, index: int) -> DataFrame:
    """One window by its number; out of range, negatives included, is an error."""
    found = windows.where(F.col("window_id") == index)
    if index < 0 or found.isEmpty():
        raise IndexError(f"no window {index}")
    return found


def head(frames, n: int) -> Column:
    """The first n of an array of frames; n from 1 to its length."""
    return _guarded(frames, n, F.slice(col(frames), F.lit(1), F.lit(n)))


def last(frames, n: int) -> Column:
    """The last n of an array of frames."""
    return _guarded(frames, n, F.slice(col(frames), F.size(col(frames)) - n + 1, F.lit(n)))


def _guarded(frames, n: int, out: Column) -> Column:
    return F.when((F.lit(n) >= 1) & (F.size(col(frames)) >= n), out).otherwise(F.raise_error(F.lit(f"no {n} frames to take")))


def extend(history, more) -> Column:
    """Frames of a rollout appended to its history."""
    return F.concat(col(history), col(more))


def collate(samples: Sequence[DataFrame]) -> DataFrame:
    """Samples of one field set as a batch with sample numbers; differing sets are an error."""
    if not samples:
        raise ValueError("nothing to collate")
    fields = [sorted(s.columns) for s in samples]
    if any(f != fields[0] for f in fields):
        raise ValueError(f"samples have different fields: {fields}")
    out = samples[0].withColumn("sample", F.lit(0))
    for k, s in enumerate(samples[1:], 1):
        out = out.unionByName(s.withColumn("sample", F.lit(k)))
    return out


def collate_pairs(pairs: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    return collate([a for a, _ in pairs]), collate([b for _, b in pairs])


def stack_cells(values: Sequence[str], x_faces: Sequence[str] = (), y_faces: Sequence[tuple[str, str]] = ()) -> Column:
    """Channels last: a cell field gives one channel, an x-face field its low and high faces, a y-face field its line and
    the next (given as two columns). All lines must have one length."""
    channels = [F.col(v) for v in values]
    for f in x_faces:
        channels += [init(F.col(f)), tail(F.col(f))]
    for low, high in y_faces:
        channels += [F.col(low), F.col(high)]
    first = channels[0]
    same = F.lit(True)
    for c in channels[1:]:
        same = same & (F.size(c) == F.size(first))
    stacked = F.transform(first, lambda _, i: F.array(*[F.get(c, i) for c in channels]))
    return F.when(first.isNotNull() & F.coalesce(same, F.lit(False)), stacked).when(first.isNotNull(), F.raise_error(F.lit("stacked fields need one shape")).cast("array<array<double>>"))  # no line, no cells


def unstack_faces(low, high) -> Column:
    """Faces from the low and high channels of cells: ends kept, shared faces averaged."""
    low, high = col(low), col(high)
    inner = F.zip_with(tail(low), init(high), lambda a, b: F.lit(0.5) * (a + b))
    return F.concat(F.array(F.element_at(low, 1)), inner, F.array(F.element_at(high, -1)))


def batch_invariants(samples: DataFrame) -> DataFrame:
    """(window_id, problem) of samples whose fields differ in their number of frames, or that hold none."""
    per = samples.groupBy("window_id", "field").agg(F.countDistinct("frame").alias("t"))
    return per.groupBy("window_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi OR lo = 0").select("window_id", F.lit("fields differ in their number of frames").alias("problem"))
