"""Properties over drawn inputs: window counts, slices, splits, reflections, merging."""


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions.expr import reflected
from gridloom.operators import slicing, split, windows

FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(st.lists(st.integers(0, 14), min_size=1, max_size=4), st.integers(1, 3), st.integers(1, 3), st.integers(1, 2), st.integers(1, 4), st.integers(0, 3))
def test_windows_equal_brute_force(spark, frames, n_in, n_out, unroll, stride, start):
    cases = spark.createDataFrame([(f"c{k}", k, n) for k, n in enumerate(frames)], "case_id string, position int, num_frames int")
    length = n_in + unroll * n_out
    want = [(f"c{k}", s) for k, n in enumerate(frames) for s in range(start, n, stride) if s + length <= n]
    got = sorted((r.window_id, r.case_id, r.start) for r in windows.window_index(cases, n_in, n_out, unroll, stride, start).collect())
    assert got == [(k, *w) for k, w in enumerate(want)]


@FEW
@given(st.integers(1, 9), st.one_of(st.none(), st.integers(-12, 12)), st.one_of(st.none(), st.integers(-12, 12)), st.one_of(st.none(), st.integers(1, 4)))
def test_slices_equal_pythons(spark, n, a, b, step):
    rows = spark.range(n).select(F.lit("a").alias("case_id"), F.col("id").cast("int").alias("frame"), F.lit(n).alias("num_frames"))
    want = list(range(n))[a:b:step]
    assert sorted(r.frame for r in slicing.slice_frames(rows, slice(a, b, step), n).collect()) == want
    assert sorted(r.frame for r in slicing.slice_frames(rows, slice(a, b, step)).collect()) == want


@FEW
@given(st.integers(40, 200), st.tuples(st.integers(1, 9), st.integers(0, 9), st.integers(0, 9)))
def test_split_sizes_fill_the_cases(spark, n, parts):
    fractions = [p / sum(parts) for p in parts]
    found = {r.split: (r.low, r.high) for r in split.sizes(spark.range(n).select(F.col("id").alias("case_id")), fractions).collect()}
    cuts = [found[name] for name in ("train", "val", "test")]
    assert cuts[0][0] == 0 and cuts[2][1] == n and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    assert all((hi > lo) == (f > 0) for (lo, hi), f in zip(cuts, fractions, strict=True))


@FEW
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=6), st.booleans())
def test_reflections_undo_themselves(spark, values, negate):
    df = spark.createDataFrame([(values,)], "v array<double>")
    once = df.select(reflected("v", negate).alias("v"))
    assert once.first().v == [-v + 0.0 if negate else v for v in reversed(values)]
    assert once.select(reflected("v", negate).alias("v")).first().v == values
