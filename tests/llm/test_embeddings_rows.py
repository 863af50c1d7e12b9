"""Repeated and null vec_ids, odd magnitudes, and what the bounds leave to full precision."""

import numpy as np

from gridloom.llm import op1_embeddings as op1

SCHEMA = "vec_id long, embedding array<double>, label int"


def result(spark, rows, **options):
    return sorted(tuple(r) for r in op1.near_vectors(spark.createDataFrame(rows, SCHEMA), **options).collect() if r.vec_id is not None)


def test_op1_repeated_ids_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [0.02, 1.0], 0)]
    assert result(spark, rows) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def test_op1_null_ids_link_with_nothing(spark):
    rows = [(None, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (6, [1.0, 0.0], 0), (None, None, None)]
    assert result(spark, rows) == [(5, 1, 5, True), (6, 1, 5, False)]
    got = [tuple(r) for r in op1.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect() if r.vec_id is None]
    assert got == [(None, 0, None, True)] * 2


def test_op1_sizes_do_not_matter(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1e-300, 1e-300], 0), (3, [5e-324, 0.0], 0), (4, [3.0, 3.0], 0), (5, [-0.0, 2.0], 0), (6, [0.0, 2.0], 0)]
    assert result(spark, rows) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 1, False), (5, 1, 5, True), (6, 1, 5, False)]


def test_op1_every_pair_is_settled_once():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(5, 24))
    x = np.repeat(base, 60, axis=0) + rng.uniform(0.05, 0.5, (300, 1)) * rng.normal(size=(300, 24))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    codes, scale, size, error = op1.quantise(unit)
    t = {"codes": codes, "scale": scale, "size": size, "error": error, "copies": rng.integers(1, 5, 300)}
    near = unit @ unit.T >= op1.THRESHOLD
    np.fill_diagonal(near, False)
    rows = np.arange(300)
    for left, right in ((rows, None), (rows[:130], rows[130:])):
        sure, doubt = op1.tile_links(t, left, right, op1.THRESHOLD)
        assert 0 < doubt.sum() and sure.count.sum() > 0
        rest = op1.tile_doubts(t, x, left, right, op1.THRESHOLD)
        mask = near if right is None else near & ((rows[:, None] < 130) != (rows < 130))
        assert (sure.count + rest.count == mask @ t["copies"]).all()
