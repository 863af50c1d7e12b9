"""Analytic checks of the grid operators on small hand-made cases."""

import functools
import json
import math
import random
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import config as cfg
from gridloom.functions.expr import allclose, gradient, hash_uniform, isclose, uniform_spacing
from gridloom.operators import augment, blocks, checks, dmd, grid, normalize, physics, slicing, split, statistics, stencil, symmetry, windows
from gridloom.sources import hdf5, tables, texts
from gridloom.streaming import running

ROWS = "case_id string, field string, frame int, j int, vals array<double>"


def lines(spark, arrays, case="a"):
    """{field: [T, Y, X]} as field lines."""
    rows = [(case, f, t, j, [float(v) for v in line]) for f, x in arrays.items() for t, frame in enumerate(x) for j, line in enumerate(frame)]
    return spark.createDataFrame(rows, ROWS)


def array(df, column="vals"):
    rows = sorted(df.select("frame", "j", column).collect())
    frames = sorted({r[0] for r in rows})
    return np.array([[r[2] for r in rows if r[0] == t] for t in frames])


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()]).select(expr.alias("x")).first().x


def test_closeness_follows_the_second_argument(spark):
    assert one(spark, isclose("p", "q", 0.1, 0.0), p=100.0, q=110.0) and not one(spark, isclose("q", "p", 0.09, 0.0), p=100.0, q=110.0)
    assert not one(spark, isclose("p", "q"), p=math.nan, q=math.nan)
    assert not one(spark, allclose("p", "q"), p=[1.0, 2.0], q=[1.0])
    with pytest.raises(Exception, match="evenly"):
        one(spark, uniform_spacing("p"), p=[0.0, 1.0, 3.0])
    with pytest.raises(Exception, match="two points"):
        one(spark, gradient("p", "p"), p=[0.0])


def test_statistics_of_one_and_three(spark):
    r = statistics.value_statistics(spark.createDataFrame([(1.0,), (3.0,)], "value double")).first()
    assert (r["count"], r["mean"], r["std"], r["min"], r["max"]) == (2, 2.0, 1.0, 1.0, 3.0)
    nan = statistics.value_statistics(spark.createDataFrame([(1.0,), (math.nan,)], "value double")).first()
    assert math.isnan(nan["mean"]) and nan["min"] == nan["max"] == 1.0
    with pytest.raises(Exception, match="no values"):
        statistics.require_data(statistics.value_statistics(spark.createDataFrame([], "value double"))).collect()


@pytest.mark.parametrize("cut", [10, 11, 400])
def test_statistics_merge_as_the_whole(spark, cut):
    v = np.random.default_rng(0).normal(size=1000)
    table = lambda x: statistics.value_statistics(spark.createDataFrame([("f", float(k)) for k in x], "field string, value double"), "field")
    merged = running.merge_records(table(v[:cut]), table(v[cut:])).first()
    assert merged["count"] == 1000 and merged["mean"] == pytest.approx(v.mean()) and merged["std"] == pytest.approx(v.std()) and merged["max"] == v.max()


def test_streamed_statistics_equal_the_batch(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(6, 2, 3))
    for t in range(6):
        lines(spark, {"f": x[t : t + 1]}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = running.keep_statistics(stream, str(tmp_path / "store"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = running.latest(spark, str(tmp_path / "store"), 2).first()
    assert got["count"] == 36 and got["mean"] == pytest.approx(x.mean()) and got["std"] == pytest.approx(x.std())


CONFIG = {"physical": {"wall_temp": 70, "bulk_temp": 58, "fluid": "FC-72", "on": True}, "non_dimensional": {"stefan": 0.5, "gravy": -1}, "discretization": {"nx_block": 16, "xl_boundary_type": "slip_ins"}, "heaters": [{"wallTemp": 0.5, "nuc_sites_x": [0.0, 1.0]}, {"wallTemp": 1.0}], "boundary": {"left": {"type": "noslip_ins"}}}


def params(spark, *configs):
    rows = [(f"c{k}", json.dumps(c)) for k, c in enumerate(configs)]
    return cfg.config_params(cfg.parse(spark.createDataFrame(rows, "case_id string, config string")))


def test_old_configurations_are_upgraded():
    c = cfg.upgrade(CONFIG)
    assert c["physical"]["wall_temp_scale"] == 70 and "wall_temp" not in c["physical"]
    assert c["boundary"]["left"] == {"type": "noslip_ins"} and "xl_boundary_type" not in c["discretization"] and set(c["boundary"]) == {"left", "right", "top", "bottom"}
    assert c["heaters"][0]["wall_temp"] == 64 and c["heaters"][1]["type"] == "constant_wall_temp"
    assert cfg.upgrade(c) == c
    with pytest.raises(ValueError, match="sides"):
        cfg.upgrade({"boundary": {"north": {}}})


def test_configuration_statistics_and_matrix(spark):
    p = params(spark, cfg.upgrade(CONFIG), cfg.upgrade(CONFIG | {"non_dimensional": {"stefan": 0.2}}))
    stats = {r.path: r for r in statistics.config_statistics(p).collect()}
    assert stats["non_dimensional.stefan"]["count"] == 2 and stats["non_dimensional.stefan"]["mean"] == pytest.approx(0.35)
    assert stats["heaters.wall_temp_fraction"]["count"] == 4 and stats["heaters.wall_temp"]["min"] == 64 and stats["non_dimensional.gravy"]["count"] == 1
    assert "physical.on" not in stats and "heaters.nuc_sites_x" not in stats
    got = {r.case_id: r.features for r in cfg.config_matrix(p, {"non_dimensional": ["stefan"], "physical": ["bulk_temp"]}).collect()}
    assert got["c1"] == pytest.approx([0.2, 58])
    for keys, text in (({"physical": ["on"]}, "no number"), ({"physical": ["fluid"]}, "no number"), ({"heaters": ["wall_temp"]}, "one heater"), ({"non_dimensional": ["gravy"]}, "missing")):
        with pytest.raises(Exception, match=text):
            cfg.config_matrix(p, keys).collect()
    assert [tuple(r) for r in cfg.missing_keys(p, {"non_dimensional": ["gravy", "stefan"]}).collect()] == [("c1", "non_dimensional.gravy")]
    for bad in ({"nope": ["x"]}, {"physical": "bulk_temp"}, {"physical": []}):
        with pytest.raises(ValueError):
            cfg.validate_keys(bad)


def test_slices_equal_pythons(spark):
    rows = lines(spark, {"f": np.arange(10.0).reshape(10, 1, 1)})
    for s in (slice(None), slice(-3, None), slice(1, 8, 3), slice(-20, 2), slice(20, None), slice(None, -1), slice(0, 9, 2)):
        want = list(range(10))[s]
        assert sorted(r.frame for r in slicing.slice_frames(rows, s, 10).collect()) == want
        assert sorted(r.frame for r in slicing.slice_frames(slicing.with_num_frames(rows), s).collect()) == want
    assert slicing.resolve_frame(-1, 4) == 3
    with pytest.raises(IndexError):
        slicing.resolve_frame(4, 4)
    with pytest.raises(KeyError):
        slicing.select_fields(rows, ["g"], ["f"])
    assert slicing.needed_fields(["vorticity", "velx"], {"vorticity": ("velx", "vely")}) == ["velx", "vely"]


def test_gradients_equal_numpy(spark):
    rng = np.random.default_rng(2)
    f, x, y = rng.normal(size=(2, 5, 7)), np.cumsum(rng.uniform(0.5, 2, 7)), np.cumsum(rng.uniform(0.5, 2, 5))
    rows = lines(spark, {"f": f}).withColumn("x", F.array(*[F.lit(float(v)) for v in x])).withColumn("y", F.array(*[F.lit(float(v)) for v in y]))
    assert array(stencil.gradient_x(rows)) == pytest.approx(np.gradient(f, x, axis=2))
    assert array(stencil.gradient_y(rows)) == pytest.approx(np.gradient(f, y, axis=1))
    assert array(stencil.diff_y(rows)) == pytest.approx(np.diff(f, axis=1))


def test_solid_body_rotation_has_vorticity_two(spark):
    y, x = np.meshgrid(np.linspace(-1, 1, 7), np.linspace(-2, 2, 9), indexing="ij")
    rows = lines(spark, {"velx": -y[None], "vely": x[None]}).withColumn("x", F.array(*[F.lit(float(v)) for v in np.linspace(-2, 2, 9)])).withColumn("y", F.array(*[F.lit(float(v)) for v in np.linspace(-1, 1, 7)]))
    assert array(stencil.vorticity(rows)) == pytest.approx(np.full((1, 7, 9), 2.0))


def wave(frames=40, dt=0.1, f=0.7, g=-0.1):
    t, rng = np.arange(frames) * dt, np.random.default_rng(3)
    p, q = rng.normal(size=(2, 8, 12))
    w = 2 * np.pi * f
    return np.exp(g * t)[:, None, None] * (np.cos(w * t)[:, None, None] * p + np.sin(w * t)[:, None, None] * q)


def test_dmd_of_a_decaying_oscillation(spark):
    data = wave()
    snaps = dmd.snapshot_rows(lines(spark, {"f": data})).repartition(5).persist()
    d = dmd.decompose(snaps, 0.1, 20)
    assert len(d.eigenvalues) == 2 and d.frequencies == pytest.approx([0.7, 0.7]) and d.continuous.real == pytest.approx([-0.1, -0.1])
    assert d.singular_values == pytest.approx(np.linalg.svd(data.reshape(40, -1).T[:, :-1], compute_uv=False), abs=1e-9)
    assert dmd.relative_error(dmd.reconstruct(snaps, d, 40), snaps).first().error < 1e-10
    assert len(d.dominant(5)) == 1
    m = {(r.j, r.i): r.modes for r in dmd.modes(snaps, d).collect()}
    norms = [math.sqrt(sum(v[k].re ** 2 + v[k].im ** 2 for v in m.values())) for k in range(2)]
    assert norms == pytest.approx(list(d.norms))
    mean = dmd.without_mean(dmd.snapshot_rows(lines(spark, {"f": wave(f=0.5, g=0.0) + 3}))).persist()
    assert [r.mean for r in mean.collect()] == pytest.approx([3.0] * 96)
    assert dmd.relative_error(dmd.reconstruct(mean, dmd.decompose(mean, 0.1, 20), 40), mean).first().error < 1e-6


def test_time_steps(spark):
    frames = lambda t: spark.createDataFrame([("a", k, v) for k, v in enumerate(t)], "case_id string, frame int, time double")
    assert dmd.time_step(frames([0.0, 0.4999000000166, 1.0])) == pytest.approx(0.5)
    for bad in ([0.0, 0.5, 1.5], [0.0]):
        with pytest.raises(ValueError):
            dmd.time_step(frames(bad))
    assert checks.check_time(frames([0.0, 0.5, 1.5])).first().severity == "warning"
    assert "[1]" in checks.check_time(frames([0.0, 1.0, 1.0])).first().message
    assert checks.check_time(frames([0.0])).collect() == []


def test_heat_flux_by_hand(spark):
    theta, dfun = np.full((2, 2, 4), 0.5), -np.ones((2, 2, 4))
    dfun[1, 0, 2] = 1
    rows = lines(spark, {"temperature": theta, "dfun": dfun})
    pairs = stencil.pair_fields(rows, "temperature", "dfun").withColumn("x", F.array(*[F.lit(v) for v in (0.25, 0.75, 1.25, 1.75)])).withColumn("y", F.array(F.lit(0.25), F.lit(0.75)))
    schema = "case_id string, heater int, type string, xMin double, xMax double, yMax double, wall_temp double, bulk_temp double, wall_temp_scale double, length_scale double, thco_liquid double, thcogas double"
    heater = lambda kind, top=0.0: spark.createDataFrame([("a", 0, kind, 0.5, 1.5, top, 70.0, 50.0, 70.0, 1e-3, 0.05, 0.2)], schema)
    got = {(r.frame, r.i): (r.x, r.flux, r.liquid) for r in physics.heater_heat_flux(pairs, heater("constant_wall_temp")).collect()}
    liquid = 0.05 * 10 / 0.25e-3
    assert set(got) == {(t, i) for t in (0, 1) for i in (1, 2)} and got[0, 1] == (0.75, pytest.approx(liquid), True) and got[1, 2] == (1.25, pytest.approx(0.2 * liquid), False)
    for bad, text in ((heater("constant_heat_flux"), "fixed flux"), (heater("constant_wall_temp", 9.0), "no cells above")):
        with pytest.raises(Exception, match=text):
            physics.heater_heat_flux(pairs, bad).collect()


def clean_case(spark):
    """Cell velocities that are the means of divergence-free faces, and a signed distance."""
    n = 6
    u, v = np.ones((2, n, n + 1)), np.full((2, n + 1, n), 0.5)
    c = (np.arange(n) + 0.5) / n
    dfun = np.tile(c - 0.5, (2, n, 1))
    rows = lines(spark, {"velfacex": u, "velfacey": v, "velx": u[:, :, :-1], "vely": v[:, :-1], "dfun": dfun, "temperature": np.full((2, n, n), 0.5)})
    faces = F.array(*[F.lit(k / n) for k in range(n + 1)])
    centers = F.array(*[F.lit(float(x)) for x in c])
    return rows.withColumn("x", centers).withColumn("y", centers), spark.range(1).select(F.lit("a").alias("case_id"), faces.alias("x_faces"), faces.alias("y_faces"))


def test_checks_are_silent_on_a_clean_case_and_speak_on_a_spoilt_one(spark):
    rows, faces = clean_case(spark)
    bounds = spark.createDataFrame([("a", 0.0, 1.0)], "case_id string, tsat double, hottest double")
    run = lambda r: {i.check for i in checks.run_all([checks.check_finite(r), checks.check_temperature(r, bounds), checks.check_signed_distance(r, 4), checks.check_cell_face(r), checks.check_divergence(r, faces, 0.1)]).collect()}
    assert run(rows) == set()
    spoil = lambda field, fn: rows.withColumn("vals", F.when(F.col("field") == field, F.transform("vals", fn)).otherwise(F.col("vals")))
    assert run(spoil("temperature", lambda v: v + 2)) == {"temperature"}
    assert run(spoil("temperature", lambda v, i: F.when(i == 1, F.lit(math.nan)).otherwise(v))) == {"finite"}
    assert run(spoil("dfun", lambda v: v * 2)) == {"signed distance"}
    assert run(spoil("velx", lambda v: v + 0.1)) == {"cell/face velocity"}
    assert run(spoil("velfacex", lambda v, i: v + 0.01 * i)) == {"cell/face velocity", "divergence"}
    assert checks.exit_code(checks.run_all([checks.check_divergence(spoil("velfacex", lambda v, i: v + 0.01 * i), faces, 0.1)])) == 1
    assert checks.exit_code(checks.run_all([checks.check_divergence(rows, faces)])) == 0


def test_mirrors(spark):
    cells = lines(spark, {"f": [[[0.5, 1.5, 2.5]]], "velx": [[[0.5, 1.5, 2.5]]]}).withColumn("x", F.array(*[F.lit(v) for v in (0.5, 1.5, 2.5)]))
    got = {r.field: (r.vals, r.x) for r in symmetry.mirror_rows(cells).collect()}
    assert got["f"] == ([2.5, 1.5, 0.5, 0.5, 1.5, 2.5], [-2.5, -1.5, -0.5, 0.5, 1.5, 2.5]) and got["velx"][0] == [-2.5, -1.5, -0.5, 0.5, 1.5, 2.5]
    faces = lines(spark, {"f": [[[0.0, 1.0, 2.0]]]}).withColumn("x", F.array(*[F.lit(v) for v in (0.0, 1.0, 2.0)]))
    assert symmetry.mirror_rows(faces).first().vals == [2, 1, 0, 1, 2]
    with pytest.raises(Exception, match="extends"):
        symmetry.mirror_rows(cells.withColumn("x", F.array(*[F.lit(v) for v in (-1.0, 0.0, 1.0)]))).collect()
    h = spark.createDataFrame([("a", [0.0, 0.5], [0.15, 0.2])], "case_id string, nuc_sites_x array<double>, nuc_seed_radii array<double>")
    r = symmetry.mirror_heaters(h).first()
    assert r.nuc_sites_x == [-0.5, 0.0, 0.5] and r.nuc_seed_radii == [0.2, 0.15, 0.2]
    wrong = spark.createDataFrame([("a", 0.0, 2.0, 6, "noslip_ins", "outflow_ins")], "case_id string, x_min double, x_max double, num_blocks_x int, left_type string, right_type string")
    with pytest.raises(Exception, match="slip wall"):
        symmetry.mirror_parameters(wrong).collect()


def test_flips_undo_themselves(spark):
    x = np.random.default_rng(4).normal(size=(2, 3, 4))
    rows = lines(spark, {"temperature": x, "velx": x, "omgm": x}).withColumn("ny", F.lit(3)).withColumn("flip_x", F.lit(True)).withColumn("flip_y", F.lit(True))
    once = symmetry.flip_rows(rows)
    assert array(once.where("field = 'velx'")) == pytest.approx(-x[:, ::-1, ::-1]) and array(once.where("field = 'omgm'")) == pytest.approx(x[:, ::-1, ::-1])
    assert array(symmetry.flip_rows(once).where("field = 'velx'")) == pytest.approx(x)
    for gravity, text in (((0.0, 0.0, 0.0), "no gravity"), ((0.0, -1.0, 1.0), "out of the plane")):
        g = spark.createDataFrame([gravity], "gravx double, gravy double, gravz double")
        with pytest.raises(Exception, match=text):
            g.select(symmetry.flippable()).collect()


def test_flips_carry_the_configuration(spark):
    x = np.random.default_rng(5).normal(size=(1, 3, 4))
    parts = [lines(spark, {"velx": x}).withColumn("window_id", F.lit(k)) for k in range(40)]
    rows = functools.reduce(lambda a, b: a.unionByName(b), parts).withColumns({"ny": F.lit(3), "gravx": F.lit(0.0), "gravy": F.lit(-1.0), "gravz": F.lit(0.0)})
    heaters = spark.createDataFrame([(k, 0.0, 4.0, 0.0, 1.0, 0.5, 1.5, 0.0, 0.1, [1.0], [0.2]) for k in range(40)], "window_id int, x_min double, x_max double, y_min double, y_max double, xMin double, xMax double, yMin double, yMax double, nuc_sites_x array<double>, nuc_sites_y array<double>")
    sides = spark.createDataFrame([(k, "slip_ins", "noslip_ins", "noslip_ins", "outflow_ins") for k in range(40)], "window_id int, left_type string, right_type string, bottom_type string, top_type string")
    flipped, h, s = augment.flip_samples(rows, heaters, sides, 0.5, 9)
    turned = {r.window_id: r.vals == [-v for v in reversed(x[0, 0].tolist())] for r in flipped.where("j = 0").collect()}
    assert 5 < sum(turned.values()) < 35
    for r in h.collect():
        assert (r.xMin, r.xMax, r.nuc_sites_x, r.yMin, r.nuc_sites_y) == ((2.5, 3.5, [3.0], 0.0, [0.2]) if turned[r.window_id] else (0.5, 1.5, [1.0], 0.0, [0.2]))
    for r in s.collect():
        assert (r.left_type, r.right_type, r.bottom_type) == (("noslip_ins", "slip_ins") if turned[r.window_id] else ("slip_ins", "noslip_ins")) + ("noslip_ins",)
    with pytest.raises(ValueError, match="two-dimensional"):
        symmetry.flip_rows(spark.createDataFrame([([[1.0]], "velx", 0, 1, True, True)], "vals array<array<double>>, field string, j int, ny int, flip_x boolean, flip_y boolean"))


def test_noise_has_its_bounds(spark):
    rows = lines(spark, {"f": np.zeros((1, 100, 200)), "g": np.zeros((1, 1, 5))}).withColumn("window_id", F.lit(3)).withColumn("part", F.lit("input"))
    noisy = augment.noise_augmentation(rows, 0.1, 0.1, seed=1, fields=["f"])
    v = array(noisy.where("field = 'f'"))
    assert v.std() == pytest.approx(0.1, rel=0.05) and abs(v.mean()) < 0.005 and not array(noisy.where("field = 'g'")).any()
    std = [r.s for r in spark.range(4000).select(augment.noise_std(0.01, 1.0, 2, "id").alias("s")).collect()]
    assert np.median(std) == pytest.approx(0.1, rel=0.1) and 0.01 <= min(std) and max(std) <= 1.0
    with pytest.raises(ValueError):
        augment.noise_augmentation(rows, 0.1, 0.1, normalized=False)
    u = [r.u for r in spark.range(2000).select(hash_uniform(1, "id").alias("u")).collect()]
    assert np.mean(u) == pytest.approx(0.5, abs=0.03)
    assert augment.flip_augmentation(rows, 0.5, training=False) is rows


def test_normalization(spark):
    stats = {"temperature": dict(count=2, mean=1.0, std=2.0, min=0.0, max=3.0), "velx": dict(count=2, mean=0.0, std=3.0, min=0.0, max=3.0), "vely": dict(count=2, mean=4.0, std=0.0, min=4.0, max=4.0)}
    config = {"physical.bulk_temp": dict(count=2, mean=50.0, std=10.0, min=40.0, max=80.0), "non_dimensional.gravy": dict(count=2, mean=-1.0, std=0.0, min=-1.0, max=-1.0)}
    n = normalize.Normalizer(stats, config, vector_fields=[("velx", "vely")])
    scales = {r.field: (r.offset, r.scale) for r in n.scales().collect()}
    assert scales == {"temperature": (1.0, 2.0), "velx": (0.0, pytest.approx(math.sqrt(12.5))), "vely": (0.0, pytest.approx(math.sqrt(12.5)))}
    rows = lines(spark, {"temperature": [[[5.0, 1.0]]]})
    assert n.normalize_fields(rows).first().vals == [2.0, 0.0]
    assert n.unnormalize_fields(n.normalize_fields(rows)).first().vals == [5.0, 1.0]
    p = spark.createDataFrame([("a", "physical", 0, "bulk_temp", v, "number") for v in (40.0, 60.0, 80.0)] + [("a", "non_dimensional", 0, "gravy", -1.0, "number"), ("a", "discretization", 0, "nx", 16.0, "number"), ("a", "physical", 0, "fluid", None, "string")], "case_id string, grp string, entry int, name string, value double, kind string")
    got = [(r.name, r.value) for r in n.normalize_config(p).collect()]
    assert [v for k, v in got if k == "bulk_temp"] == [-1.0, 0.0, 1.0] and ("gravy", 0.0) in got and ("nx", 16.0) in got
    standard = normalize.Normalizer(stats, config, "standard")
    assert [r.value for r in standard.normalize_config(p.where("name = 'bulk_temp'")).collect()] == [-1.0, 1.0, 3.0]
    assert {r.field: (r.offset, r.scale) for r in normalize.Normalizer.from_json(n.to_json()).scales().collect()} == scales
    for twice in (lambda: n.normalize_fields(n.normalize_fields(rows)), lambda: n.unnormalize_fields(rows)):
        with pytest.raises(ValueError, match="already"):
            twice()
    with pytest.raises(ValueError, match="no cases"):
        windows.case_rows(n.normalize_fields(rows).withColumn("part", F.lit("input")))
    for bad in ({"config_scaling": "other"}, {"vector_fields": [["velx"]]}, {"vector_fields": [["velx", "vely"], ["velx", "temperature"]]}, {"vector_fields": [["velx", "pressure"]]}):
        with pytest.raises(ValueError):
            normalize.Normalizer(stats, config, **bad)
    with pytest.raises(Exception, match="pressure"):
        n.normalize_fields(rows.withColumn("field", F.lit("pressure"))).collect()
    with pytest.raises(Exception, match="physical.unknown"):
        n.normalize_config(p.withColumn("name", F.lit("unknown")).where("grp = 'physical' AND kind = 'number'")).collect()

    def double(batches):
        import pyarrow as pa

        for b in batches:
            vals = pa.array([[2 * v for v in x] for x in b.column("vals").to_pylist()])
            yield b.set_column(b.schema.get_field_index("vals"), "vals", vals)

    assert n.forward(rows, double, ROWS).first().vals == [9.0, 1.0]
    marked = normalize.State.mark(rows, True)
    with pytest.raises(ValueError, match="already"):
        normalize.State.mark(marked, True)


@pytest.mark.parametrize("n_in,n_out,unroll,stride,start,want", [(1, 1, 1, 1, 0, list(range(9))), (1, 1, 1, 3, 0, [0, 3, 6]), (1, 1, 1, 3, 1, [1, 4, 7]), (1, 1, 1, 8, 0, [0, 8]), (1, 1, 1, 9, 0, [0]), (2, 2, 3, 1, 0, [0, 1, 2]), (9, 9, 1, 1, 0, [])])
def test_window_starts(spark, n_in, n_out, unroll, stride, start, want):
    cases = spark.createDataFrame([("a", 0, 10), ("b", 1, 10), ("c", 2, 1)], "case_id string, position int, num_frames int")
    got = sorted((r.window_id, r.case_id, r.start) for r in windows.window_index(cases, n_in, n_out, unroll, stride, start).collect())
    assert got == [(k, c, s) for k, (c, s) in enumerate([(c, s) for c in "ab" for s in want])]


def test_window_arguments_and_guards(spark):
    for bad in ((0, 1), (1, 0), (1, 1, 0), (1, 1, 1, 0), (1, 1, 1, 1, -1)):
        with pytest.raises(ValueError):
            windows.validate_windows(*bad)
    index = spark.createDataFrame([(0, "a", 0)], "window_id long, case_id string, start int")
    for k in (-1, 1):
        with pytest.raises(IndexError):
            windows.window_at(index, k)
    frames = spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("f"))
    assert frames.select(windows.head("f", 1).alias("x")).first().x == [1] and frames.select(windows.last("f", 2).alias("x")).first().x == [1, 2]
    for n in (0, 3):
        with pytest.raises(Exception, match="frames to take"):
            frames.select(windows.head("f", n)).collect()
    with pytest.raises(ValueError):
        windows.collate([frames, frames.withColumn("g", F.lit(1))])
    assert windows.collate([frames, frames]).count() == 2
    rows = lines(spark, {"f": np.arange(40.0).reshape(10, 2, 2)})
    got = windows.window_rows(spark.createDataFrame([(0, "a", 4)], "window_id long, case_id string, start int"), rows, 3, 2)
    assert sorted((r.part, r.frame, r.j, r.vals[0]) for r in got.collect())[:2] == [("input", 0, 0, 16.0), ("input", 0, 1, 18.0)]
    assert windows.batch_invariants(got.where("part = 'input'")).collect() == []


def test_faces_unstack(spark):
    df = spark.range(1).select(F.array(*[F.lit(v) for v in (0.0, 1.0, 2.0)]).alias("lo"), F.array(*[F.lit(v) for v in (10.0, 11.0, 12.0)]).alias("hi"))
    assert df.select(windows.unstack_faces("lo", "hi").alias("x")).first().x == [0, 5.5, 6.5, 12]


def test_splits(spark):
    cases = lambda names: spark.createDataFrame([(n,) for n in names], "case_id string")
    count = lambda n, f: [r.high - r.low for r in split.sizes(cases([str(k) for k in range(n)]), f).orderBy("low", "high").collect()]
    assert count(10, [0.8, 0.1, 0.1]) == [8, 1, 1] and count(3, [0.98, 0.01, 0.01]) == [1, 1, 1]
    a, b = (split.manifest(split.split_cases(cases(names), [0.6, 0.2, 0.2], 3)) for names in ("abcdefghij", "jihgfedcba"))
    assert a == b and sorted(sum(a.values(), [])) == list("abcdefghij")
    order = list("abcdefghij")
    random.Random(3).shuffle(order)
    assert list(a.values()) == [sorted(order[:6]), sorted(order[6:8]), sorted(order[8:])]
    for n, f in ((5, [0.5, 0.5]), (5, [0.9, 0.2, -0.1])):
        with pytest.raises(ValueError):
            count(n, f)
    with pytest.raises(Exception, match="too few"):
        count(2, [0.8, 0.1, 0.1])


def test_blocks_assemble_cells_and_faces(spark):
    rng = np.random.default_rng(5)
    cells, xf, yf = rng.normal(size=(4, 6)), rng.normal(size=(4, 7)), rng.normal(size=(5, 6))
    layout, tiles = [], []
    for row in range(2):
        for col in range(2):
            b = 3 - (2 * row + col)  # stored in another order
            layout.append(("a", b, 1, 2, col * 1.0, col + 1.0, row * 2.0, row * 2 + 2.0, 2, 2))
            for f, x, h, w in (("temperature", cells, 2, 3), ("velfacex", xf, 2, 4), ("velfacey", yf, 3, 3)):
                tiles.append(("a", 0, f, b, x[row * 2 : row * 2 + h, col * 3 : col * 3 + w].tolist()))
    schema = "case_id string, block int, level int, dimensionality int, x_low double, x_high double, y_low double, y_high double, n_cols int, n_rows int"
    places = blocks.block_places(spark.createDataFrame(layout, schema))
    rows = blocks.assemble(spark.createDataFrame(tiles, "case_id string, frame int, field string, block int, data array<array<double>>").join(places, ["case_id", "block"]))
    for f, x in (("temperature", cells), ("velfacex", xf), ("velfacey", yf)):
        assert array(rows.where(F.col("field") == f)) == pytest.approx(x[None])
    for change, text in (((2, 2), "refined"), ((3, 3), "two-dimensional")):
        bad = [tuple(change[1] if k == change[0] else v for k, v in enumerate(r)) for r in layout]
        with pytest.raises(Exception, match=text):
            blocks.block_places(spark.createDataFrame(bad, schema)).collect()
    with pytest.raises(Exception, match="fill"):
        blocks.block_places(spark.createDataFrame(layout[:3], schema)).collect()
    gap = spark.createDataFrame([("a", 0, "f"), ("a", 0, "g"), ("a", 1, "f")], "case_id string, frame int, field string")
    assert [tuple(r) for r in blocks.incomplete_frames(gap).collect()] == [("a", 1, "g")]
    named = spark.createDataFrame([("temp ",), ("curv",)], "v string").select(blocks.renamed(F.col("v")).alias("n"))
    assert [r.n for r in named.collect()] == ["temperature", "curv"]


def test_case_tables_round_trip(spark, tmp_path):
    x = np.arange(24.0).reshape(3, 2, 4)
    rows = lines(spark, {"f": x, "velfacex": np.zeros((3, 2, 5))})
    disc = spark.createDataFrame([("a", 0.0, 1.0, 1, 4, 0.0, 1.0, 1, 2)], "case_id string, x_min double, x_max double, num_blocks_x int, nx_block int, y_min double, y_max double, num_blocks_y int, ny_block int")
    frames = spark.createDataFrame([("a", t, 50.0 + t) for t in range(3)], "case_id string, frame int, time double")
    cases = spark.createDataFrame([("a", json.dumps({"physical": {"bulk_temp": 58}}), None)], "case_id string, config string, units string")
    path = str(tmp_path / "store")
    tables.write_case_tables(path, rows, frames, grid.build_grid(disc), cases)
    assert tables.field_names(spark, path) == ["f", "velfacex"] and tables.num_timesteps(spark, path) == 3
    some = tables.read_fields(spark, path, ["f"], slice(-2, None))
    assert array(some) == pytest.approx(x[1:])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan or "PartitionFilters: [field" in plan or "field#" in plan and "PushedFilters: [IsNotNull(frame)" in plan
    assert cfg.config_params(tables.read_parameters(spark, path)).first().value == 58 and tables.read_units(spark, path).first().units == {}
    with pytest.raises(KeyError):
        tables.read_fields(spark, path, ["g"])
    with pytest.raises(ValueError, match="off the described grid"):
        tables.write_case_tables(str(tmp_path / "bad"), lines(spark, {"f": np.zeros((3, 2, 9))}), frames, grid.build_grid(disc), cases)
    bare = spark.createDataFrame([("a", None)], "case_id string, config string")
    bare.write.parquet(str(tmp_path / "bare" / "cases"))
    with pytest.raises(Exception, match="no parameters"):
        tables.read_parameters(spark, str(tmp_path / "bare")).collect()
    side = spark.createDataFrame([("a", '{"physical":{"bulk_temp":1}}')], "case_id string, config string")
    assert cfg.config_params(tables.read_parameters(spark, str(tmp_path / "bare"), side)).first().value == 1
    fs = statistics.value_statistics(statistics.cells(rows).select("field", "value"), "field")
    text = tables.statistics_json(fs, statistics.config_statistics(cfg.config_params(tables.read_parameters(spark, path))))
    fields, config = tables.read_statistics(text)
    assert text.endswith("}\n") and fields["f"]["count"] == 24 and config["physical.bulk_temp"]["mean"] == 58


def test_side_files(spark, tmp_path):
    (tmp_path / "flash.par").write_text("a = 1\n  HTR_numheaters = 3\n")
    (tmp_path / "parameters.json").write_text(json.dumps({"Physical": {"wall_temp": 70, "sat_temp": 58}}))
    (tmp_path / "split.json").write_text(json.dumps({"train": ["a", "b"], "val": ["c"]}))
    assert texts.heater_count(spark, str(tmp_path / "flash.par")).first().heaters == 3
    assert texts.physical_parameters(spark, str(tmp_path / "parameters.json")).first().physical == {"wall_temp_scale": "70", "sat_temp": "58", "bulk_temp": "58"}
    assert sorted(tuple(r) for r in texts.split_manifest(spark, str(tmp_path / "split.json")).collect()) == [("train", "a"), ("train", "b"), ("val", "c")]
    files = spark.createDataFrame([(f"/d/x_hdf5_plt_cnt_{k:04d}",) for k in (2, 0, 1)] + [("/d/x_hdf5_htr_0001",), ("/d/notes",)], "path string")
    assert [r.path[-1] for r in texts.listed_files(files).orderBy("frame").collect()] == ["0", "1", "2"] and texts.listed_files(files, "heater").count() == 1
    run = spark.createDataFrame([("a", "ht_prandtl", "7.35"), ("a", "ins_gravy", "-1")], "case_id string, name string, value string")
    assert {r.name: r.value for r in texts.non_dimensional(run).collect()} == {"prandtl": 7.35, "gravy": -1.0, "gravx": 0.0, "gravz": 0.0}
    odd = texts.heater_count_issues(spark.createDataFrame([("a", 2)], "case_id string, found int"), spark.createDataFrame([("a", 3)], "case_id string, stated int"))
    assert odd.first().severity == "warning"
    d = spark.range(1).select(F.array(F.lit(" k "), F.lit("m")).alias("n"), F.array(F.lit(" v"), F.lit("w ")).alias("v")).select(texts.decoded_table("n", "v").alias("m"))
    assert d.first().m == {"k": "v", "m": "w"}


def test_hdf5_rows_with_a_stand_in(monkeypatch, tmp_path):
    store = {"f": np.arange(8.0).reshape(2, 2, 2), "time": np.zeros(2), "x_faces": np.zeros(3)}

    class File(dict):
        def __init__(self, *_):
            super().__init__(store)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    monkeypatch.setitem(__import__("sys").modules, "h5py", types.SimpleNamespace(File=File))
    reader = hdf5.CaseHdf5({"path": str(tmp_path / "c.hdf5"), "start": "1"}).reader(None)
    assert list(reader.read(reader.partitions()[0])) == [("c", "f", 1, 0, [4.0, 5.0]), ("c", "f", 1, 1, [6.0, 7.0])]
    with pytest.raises(KeyError):
        bad = hdf5.CaseHdf5({"path": "c.hdf5", "fields": "g"}).reader(None)
        list(bad.read(bad.partitions()[0]))
    with pytest.raises(FileNotFoundError):
        hdf5.SolverDump({"path": str(tmp_path)}).reader(None)


def test_rollout_keeps_the_last_frames(spark):
    h = spark.createDataFrame([(0, [1, 2, 3])], "window_id int, frames array<int>")
    p = spark.createDataFrame([(0, [4, 5])], "window_id int, frames array<int>")
    assert running.rollout_step(h, p, 3).first().frames == [3, 4, 5]
