"""The facade and the jobs over a small store."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import jobs
from gridloom.api import Cases
from gridloom.operators import grid
from gridloom.sources import tables, texts
from tests.test_operators import array, lines


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    n, t = 8, np.arange(12) * 0.5
    c = (np.arange(n) + 0.5) / n
    wave = np.cos(2 * np.pi * 0.25 * t)[:, None, None] * np.random.default_rng(7).normal(size=(n, n)) * 0.1 + 0.5
    rows = lines(spark, {"velfacex": np.ones((12, n, n + 1)), "velfacey": np.ones((12, n + 1, n)), "velx": np.ones((12, n, n)), "vely": np.ones((12, n, n)), "dfun": np.tile(c - 0.5, (12, n, 1)), "temperature": wave})
    config = {
        "physical": {"wall_temp_scale": 70.0, "bulk_temp": 58.0, "sat_temp": 58.0, "length_scale": 7e-4, "velocity_scale": 0.07, "time_scale": 0.01, "rho_liquid": 1620.0, "thco_liquid": 0.054},
        "non_dimensional": {k: 0.5 for k in ("gravx", "gravy", "gravz", "inv_reynolds", "inflow_velscale", "prandtl", "stefan", "inv_weber", "cpgas", "mugas", "rhogas", "thcogas")} | {"tsat": 0.0},
        "discretization": {"num_blocks_x": 2, "num_blocks_y": 2, "nx_block": 4, "ny_block": 4, "x_min": 0.0, "x_max": 1.0, "y_min": 0.0, "y_max": 1.0, "dt": 0.5, "t_initial": 0.0},
        "heaters": [{"type": "constant_wall_temp", "wall_temp_fraction": 1.0, "nuc_sites_x": [0.0, 0.5], "nuc_sites_y": [0.0, 0.0], "nuc_seed_radii": [0.1, 0.2]} | {k: 0.0 for k in ("xMin", "yMin", "zMin", "zMax", "advAngle", "rcdAngle", "velContact", "nucWaitTime")} | {"xMax": 0.9, "yMax": 0.1}],
        "boundary": {"left": {"type": "slip_ins"}, "right": {"type": "outflow_ins"}, "bottom": {"type": "noslip_ins"}, "top": {"type": "outflow_ins"}},
    }
    disc = spark.createDataFrame([("a", 0.0, 1.0, 2, 4, 0.0, 1.0, 2, 4)], "case_id string, x_min double, x_max double, num_blocks_x int, nx_block int, y_min double, y_max double, num_blocks_y int, ny_block int")
    frames = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(t)], "case_id string, frame int, time double")
    path = str(tmp_path_factory.mktemp("store") / "s")
    Cases(rows, frames, grid.build_grid(disc), None).to_tables(path, spark.createDataFrame([("a", json.dumps(config), None)], "case_id string, config string, units string"))
    return path


def test_facade(spark, store):
    cases = Cases.from_tables(spark, store)
    assert cases.check().collect() == []
    fields, config = cases.statistics()
    assert fields.count() == 6 and {r.path for r in config.collect()} >= {"physical.bulk_temp", "heaters.wall_temp_fraction"}
    assert array(cases.vorticity()) == pytest.approx(np.zeros((12, 8, 8)))
    whole = cases.mirrored()
    assert whole.rows.where("field = 'velfacex' AND frame = 0 AND j = 0").first().vals == [-1.0] * 8 + [1.0] * 9
    assert {r.name: r.value for r in whole.params.where("grp = 'discretization'").collect()}.items() >= {"x_min": -1.0, "num_blocks_x": 4.0, "mirrored_about_x": 0.0, "x_max": 1.0}.items()
    assert whole.heaters.first().nuc_sites_x == [-0.5, 0.0, 0.5] and whole.heaters.first().nuc_seed_radii == [0.2, 0.1, 0.2] and whole.sides.first().left_type == "outflow_ins"
    assert whole.located().where("field = 'temperature'").first().x[0] == pytest.approx(-15 / 16) and [r.check for r in whole.check().collect() if r.severity == "error"] == ["cell/face velocity"]
    off = Cases.from_tables(spark, store)
    bad = Cases(off.rows, off.frames, off.grid, off.params, off.heaters.withColumn("xMax", F.lit(-1.0)), off.sides)
    assert {(r.check, r.severity) for r in bad.check().collect()} >= {("heaters", "error")}
    assert cases.time_slice(3).rows.select("frame").distinct().count() == 1
    _, d = cases.spectrum("a", "temperature", subtract_mean=False)
    assert len(d.eigenvalues) >= 2
    spoilt = Cases(cases.rows.withColumn("vals", F.when(F.col("field") == "velx", F.transform("vals", lambda v: v + 1)).otherwise(F.col("vals"))), cases.frames, cases.grid, cases.params)
    assert [r.check for r in spoilt.check().collect()] == ["cell/face velocity"]


def test_jobs(spark, store, tmp_path, capsys):
    assert jobs.main(["check", store], spark) == 0
    assert jobs.main(["statistics", store, "--output", str(tmp_path / "s.json")], spark) == 0
    assert tables.read_statistics((tmp_path / "s.json").read_text())[0]["velx"]["mean"] == 1.0
    assert jobs.main(["dmd", store, "a", "temperature", "--rank", "4", "--output", str(tmp_path / "d")], spark) == 0
    assert "relative error" in capsys.readouterr().out
    assert jobs.main(["split", store, "--fractions", "1", "0", "0", "--output", str(tmp_path / "split.json")], spark) == 0
    assert jobs.main(["convert", store, "--fields", "temperature", "dfun", "--frames", "2:6", "--mirror", "--output", str(tmp_path / "half")], spark) == 0
    made = Cases.from_tables(spark, str(tmp_path / "half"))
    assert {(r.field, r.n) for r in made.rows.groupBy("field").agg(F.countDistinct("frame").alias("n")).collect()} == {("temperature", 4), ("dfun", 4)}
    assert made.located().where("field = 'dfun'").first().x[0] < -0.9
    with pytest.raises(FileExistsError):
        jobs.main(["split", store, "--fractions", "1", "0", "0", "--output", str(tmp_path / "split.json")], spark)


def test_dump_parameters(spark, tmp_path):
    run = spark.createDataFrame([("a", "geometry", "cartesian "), ("a", "plotfileintervaltime", "0.5"), ("a", "tinitial", "0"), ("a", "tmax", "100"), ("a", "xl_boundary_type", " slip_ins")], "case_id string, name string, value string")
    layout = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 3.0, 2, 1, 16, 16), ("a", 1.0, 2.0, 0.0, 3.0, 2, 1, 16, 16)], "case_id string, x_low double, x_high double, y_low double, y_high double, n_cols int, n_rows int, nx_block int, ny_block int")
    d = texts.discretization(run, layout).first()
    assert (d.geometry, d.dt, d.t_final, d.num_blocks_x, d.x_max, d.y_max) == ("cartesian", 0.5, 100.0, 2, 2.0, 3.0)
    assert [tuple(r) for r in texts.boundary_types(run).collect()] == [("a", "left", "slip_ins")]
    (tmp_path / "case-1").mkdir()
    assert texts.case_folders(str(tmp_path), "case")[0].endswith("case-1")
    with pytest.raises(FileNotFoundError):
        texts.case_folders(str(tmp_path), "other")
