"""One object for a set of cases: where they come from, what can be asked of them, where they go."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import config as cfg
from gridloom.functions.fixed import NEGATED_BY_X_FLIP
from gridloom.operators import blocks, checks, dmd, grid, slicing, statistics, stencil, symmetry
from gridloom.sources import hdf5, tables


@dataclass(frozen=True)
class Cases:
    """field_rows (case_id, field, frame, j, vals), frames (case_id, frame, time), grid (case_id, axis, loc, coords) and
    params (the long configuration table); heaters as checks.check_heaters takes them and sides (case_id, left_type, ...),
    where known."""

    rows: DataFrame
    frames: DataFrame
    grid: DataFrame
    params: DataFrame
    heaters: DataFrame | None = None
    sides: DataFrame | None = None

    @classmethod
    def from_tables(cls, spark: SparkSession, path: str, fields: list[str] | None = None, frames: slice | None = None, mirror: bool = False) -> Cases:
        """The Parquet store; field names and frames reach the scan. mirror: the full domain of symmetric cases."""
        rows = tables.read_fields(spark, path, fields, frames)
        time = spark.read.parquet(f"{path}/frames")
        if frames is not None:
            time = slicing.slice_frames(time, frames, tables.num_timesteps(spark, path))
        config = tables.read_parameters(spark, path)
        found = cls(rows, time, spark.read.parquet(f"{path}/grid"), cfg.config_params(config), cfg.heater_rows(config), cfg.side_types(config))
        return found.mirrored() if mirror else found

    @classmethod
    def from_dump(cls, spark: SparkSession, folder: str, params: DataFrame, grid_rows: DataFrame) -> Cases:
        """A solver's dump directory (needs h5py): blocks placed and put together, a task a plot file."""
        hdf5.register(spark)
        raw = spark.read.format("solver_dump").load(folder)
        if lacking := blocks.incomplete_frames(raw).limit(5).collect():
            raise ValueError(f"frames without a variable of the first frame: {[tuple(r) for r in lacking]}")
        first = raw.where("frame = 0").select("case_id", "block", "level", "dimensionality", "x_low", "x_high", "y_low", "y_high", "n_cols", "n_rows").distinct()
        placed = raw.select("case_id", "frame", "field", "block", "data").join(blocks.block_places(first), ["case_id", "block"])
        return cls(blocks.assemble(placed), raw.select("case_id", "frame", "time").distinct(), grid_rows, params)

    def to_tables(self, path: str, cases: DataFrame) -> None:
        tables.write_case_tables(path, self.rows, self.frames, self.grid, cases)

    def field(self, name: str) -> DataFrame:
        return slicing.select_fields(self.rows, [name])

    def time_slice(self, start: int, stop: int | None = None) -> Cases:
        return replace(self, rows=slicing.time_slice(self.rows, start, stop), frames=slicing.time_slice(self.frames, start, stop))

    def located(self) -> DataFrame:
        """Rows with the coordinate arrays of their field's own place."""
        wide = self.grid.groupBy("case_id").agg(*[F.first(F.when((F.col("axis") == a) & (F.col("loc") == p), F.col("coords")), ignorenulls=True).alias(f"{a}_{p}") for a in "xy" for p in ("centers", "faces")])
        at = grid.require_located(grid.infer_locations(self.rows, self.grid))
        pick = lambda a: F.when(F.col(f"{a}_loc") == "centers", F.col(f"{a}_centers")).otherwise(F.col(f"{a}_faces")).alias(a)
        coords = at.join(wide, "case_id").select("case_id", "field", pick("x"), pick("y"), "x_faces", "y_faces")
        return self.rows.join(coords, ["case_id", "field"])

    def statistics(self) -> tuple[DataFrame, DataFrame]:
        """Field and configuration statistics."""
        return statistics.require_data(statistics.field_statistics(self.rows)), statistics.config_statistics(self.params)

    def vorticity(self) -> DataFrame:
        return stencil.vorticity(self.located())

    def spectrum(self, case_id, field: str, rank: int = 20, subtract_mean: bool = True) -> tuple[DataFrame, dmd.Decomposition]:
        """A case's snapshots of a field and their decomposition."""
        own = self.rows.where((F.col("case_id") == case_id) & (F.col("field") == field))
        snaps = dmd.snapshot_rows(own)
        snaps = dmd.without_mean(snaps) if subtract_mean else snaps
        return snaps, dmd.decompose(snaps, dmd.time_step(self.frames.where(F.col("case_id") == case_id)), rank)

    def mirrored(self, negated=NEGATED_BY_X_FLIP) -> Cases:
        """The full domain of cases that are symmetric about x = 0: lines, grid, parameters, heaters and boundary. A case
        without a slip wall at x = 0 on its left is an error."""
        rows = symmetry.mirror_rows(self.located().select("case_id", "field", "frame", "j", "vals", "x"), negated=negated).drop("x")
        at = lambda n: F.max(F.when((F.col("grp") == "discretization") & (F.col("name") == n), F.col("value"))).alias(n)
        half = self.params.groupBy("case_id").agg(at("x_min"), at("x_max"), at("num_blocks_x")).join(self.sides, "case_id", "left")
        whole = symmetry.mirror_parameters(half)
        changed = whole.select("case_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("new")) for n in ("x_min", "num_blocks_x", "mirrored_about_x")])).alias("c")).select("case_id", F.lit("discretization").alias("grp"), "c.*")
        both = self.params.join(changed, ["case_id", "grp", "name"], "full_outer")
        params = both.select("case_id", "grp", F.coalesce("entry", F.lit(0)).alias("entry"), "name", F.coalesce("new", "value").alias("value"), F.coalesce("kind", F.lit("number")).alias("kind"))
        sides = whole.select("case_id", *[c for c in self.sides.columns if c != "case_id"])
        return replace(self, rows=rows, grid=symmetry.mirror_grid(self.grid), params=params, heaters=None if self.heaters is None else symmetry.mirror_heaters(self.heaters), sides=sides)

    def selected(self, keep) -> Cases:
        """The cases whose ids are in `keep` (one row a case)."""
        of = lambda t: None if t is None else t.join(keep.select("case_id"), "case_id", "left_semi")
        return Cases(*map(of, (self.rows, self.frames, self.grid, self.params, self.heaters, self.sides)))

    def check(self) -> DataFrame:
        """Every check whose fields and parameters are there, in a fixed order; an absent field yields nothing."""
        located = self.located()
        faces = located.groupBy("case_id").agg(F.first("x_faces").alias("x_faces"), F.first("y_faces").alias("y_faces"))
        p = self.params
        number = lambda g, n: F.max(F.when((F.col("grp") == g) & (F.col("name") == n), F.col("value")))
        bounds = p.groupBy("case_id").agg(number("non_dimensional", "tsat").alias("tsat"), number("heaters", "wall_temp_fraction").alias("hottest"))
        found = [checks.check_parameters(p)]
        if self.heaters is not None:
            extents = p.groupBy("case_id").agg(*[number("discretization", n).alias(n) for n in ("x_min", "x_max")], *[number("physical", n).alias(n) for n in ("bulk_temp", "wall_temp_scale")])
            found.append(checks.check_heaters(extents, self.heaters))
        found += [checks.check_time(self.frames), checks.check_finite(self.rows), checks.check_temperature(self.rows, bounds), checks.check_signed_distance(located), checks.check_cell_face(self.rows), checks.check_divergence(self.rows, faces)]
        return checks.run_all(found)
