"""Optional HDF5 sources as Python data sources: needs h5py on driver and executors, imported only when one is used.

case_hdf5     one file a case: every dataset but time and the grid vectors is a field [frames, y, x]
solver_dump   a directory of plot files: one partition a file, each giving its blocks
heater_files  the heater files of such a directory

Neither could be run where this was written (h5py wasn't there); their row mapping is tested with a stand-in module.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.functions.fixed import FIELD_NAMES, HEATER_PATTERN, HEATER_SCALARS, PLOTFILE_PATTERN, WALL_TEMP

GRID_NAMES = ("x_faces", "y_faces", "x_centers", "y_centers")
FACES = ("fv_x", "fv_y")


class _Part(InputPartition):
    def __init__(self, path: str, frame: int):
        super().__init__((path, frame))
        self.path, self.frame = path, frame


class _CaseReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(glob.glob(options["path"])) or [options["path"]]
        self.names = [n for n in options.get("fields", "").split(",") if n]
        self.start, self.stop = int(options.get("start", 0)), options.get("stop")

    def partitions(self):
        return [_Part(p, k) for k, p in enumerate(self.paths)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import h5py

        case = os.path.splitext(os.path.basename(partition.path))[0]
        with h5py.File(partition.path, "r") as f:
            stored = sorted(n for n in f if n != "time" and n not in GRID_NAMES)
            if missing := sorted(set(self.names) - set(stored)):
                raise KeyError(f"{partition.path} has no fields {missing}; it has {stored}")
            for name in self.names or stored:
                data = f[name]
                stop = min(int(self.stop), data.shape[0]) if self.stop is not None else data.shape[0]
                for t in range(self.start, stop):  # a frame at a time: memory holds one
                    for j, line in enumerate(data[t]):
                        yield case, name, t, j, [float(v) for v in line]


class CaseHdf5(DataSource):
    @classmethod
    def name(cls):
        return "case_hdf5"

    def schema(self):
        return "case_id string, field string, frame int, j int, vals array<double>"

    def reader(self, schema):
        return _CaseReader(self.options)


class _DumpReader(DataSourceReader):
    def __init__(self, options):
        folder = options["path"]
        names = sorted(n for n in os.listdir(folder) if re.search(PLOTFILE_PATTERN, n))
        if not names:
            raise FileNotFoundError(f"no plot files in {folder}")
        self.case, self.files = os.path.basename(os.path.normpath(folder)), [os.path.join(folder, n) for n in names]

    def partitions(self):
        return [_Part(p, k) for k, p in enumerate(self.files)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import h5py

        text = lambda v: v.decode().strip() if isinstance(v, bytes) else v
        with h5py.File(partition.path, "r") as f:
            ints = {text(k): int(v) for k, v in f["integer scalars"][()]}
            grid = {text(k): int(v) for k, v in f["integer runtime parameters"][()]}
            time = float({text(k): v for k, v in f["real scalars"][()]}["time"])
            levels, box = f["refine level"][()], f["bounding box"][()]
            variables = [text(n) for (n,) in f["unknown names"][()]] + [n for n in FACES if n in f]
            for name in variables:
                data = f[name]
                for b in range(len(levels)):
                    block = [[float(v) for v in line] for line in data[b][0]]
                    yield (self.case, partition.frame, time, FIELD_NAMES.get(name, name), b, int(levels[b]), ints["dimensionality"], float(box[b][0][0]), float(box[b][0][1]), float(box[b][1][0]), float(box[b][1][1]), grid["nblockx"], grid["nblocky"], block)


class SolverDump(DataSource):
    @classmethod
    def name(cls):
        return "solver_dump"

    def schema(self):
        return "case_id string, frame int, time double, field string, block int, level int, dimensionality int, x_low double, x_high double, y_low double, y_high double, n_cols int, n_rows int, data array<array<double>>"

    def reader(self, schema):
        return _DumpReader(self.options)


class _HeaterReader(DataSourceReader):
    def __init__(self, options):
        folder = options["path"]
        self.case = os.path.basename(os.path.normpath(folder))
        self.files = [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if re.search(HEATER_PATTERN, n)]

    def partitions(self):
        return [_Part(p, k) for k, p in enumerate(self.files)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import h5py

        flat = lambda v: [float(x) for x in v[()].ravel()]
        with h5py.File(partition.path, "r") as f:
            own, site = f["heater"], f["site"]
            scalars = {("wall_temp_fraction" if n == "wallTemp" else n): flat(own[n])[0] for n in HEATER_SCALARS if n in own}
            yield self.case, partition.frame, WALL_TEMP, scalars, flat(site["x"]), flat(site["y"]), flat(site["z"]) if "z" in site else None, flat(f["init"]["radii"])


class HeaterFiles(DataSource):
    """The heater files of a dump directory: one row a heater, its scalars under today's names."""

    @classmethod
    def name(cls):
        return "heater_files"

    def schema(self):
        return "case_id string, heater int, type string, scalars map<string,double>, nuc_sites_x array<double>, nuc_sites_y array<double>, nuc_sites_z array<double>, nuc_seed_radii array<double>"

    def reader(self, schema):
        return _HeaterReader(self.options)


def write_case(path: str, fields: dict, time: list, grid: dict, parameters: str, units: str) -> None:
    """One case file on the driver, for export of a case that fits it: datasets, time, grid vectors and JSON attributes."""
    import h5py

    with h5py.File(path, "w") as f:
        f.attrs["parameters"], f.attrs["units"] = parameters, units
        for name, data in (fields | {"time": time} | grid).items():
            f.create_dataset(name, data=data)


def register(spark: SparkSession) -> None:
    for source in (CaseHdf5, SolverDump, HeaterFiles):
        spark.dataSource.register(source)
