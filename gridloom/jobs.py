"""Jobs for spark-submit: python -m gridloom.jobs statistics|check|dmd|split|convert ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from gridloom.api import Cases
from gridloom.operators import checks, dmd, split
from gridloom.sources import tables, texts


def _slice(text: str) -> slice:
    return slice(*[int(p) if p else None for p in text.split(":")]) if ":" in text else slice(int(text), int(text) + 1)


def statistics_job(spark: SparkSession, a) -> int:
    """Statistics of a store's cases (those of a split's training part, if given) as JSON."""
    cases = Cases.from_tables(spark, a.store)
    if a.split:
        cases = cases.selected(texts.split_manifest(spark, a.split).where("split = 'train'"))
    Path(a.output).write_text(tables.statistics_json(*cases.statistics()))
    return 0


def check_job(spark: SparkSession, a) -> int:
    """Prints a store's issues; 1 if any is an error."""
    issues = Cases.from_tables(spark, a.store, a.fields or None, _slice(a.frames) if a.frames else None, a.mirror).check().persist()
    for r in issues.toLocalIterator():
        print(f"{r.case_id} [{r.severity}] {r.check}: {r.message}")
    return checks.exit_code(issues)


def dmd_job(spark: SparkSession, a) -> int:
    """A case's spectrum as a table under the output path, and the reconstruction's relative error."""
    snaps, found = Cases.from_tables(spark, a.store, [a.field]).spectrum(a.case, a.field, a.rank)
    found.table(spark).write.mode("errorifexists").parquet(a.output)
    frames = len(found.projection) + 1
    print(f"rank {len(found.eigenvalues)}, relative error {dmd.relative_error(dmd.reconstruct(snaps, found, frames), snaps).first().error:.3g}")
    return 0


def split_job(spark: SparkSession, a) -> int:
    """A split manifest of a store's cases; refuses to write over one."""
    manifest = split.manifest(split.split_cases(spark.read.parquet(f"{a.store}/cases"), a.fractions, a.seed))
    if Path(a.output).exists():
        raise FileExistsError(a.output)
    if not a.dry_run:
        Path(a.output).write_text(json.dumps(manifest, indent=4) + "\n")
    print({k: len(v) for k, v in manifest.items()})
    return 0


def convert_job(spark: SparkSession, a) -> int:
    """A new store of a store's cases: the fields and frames asked for, mirrored if asked. Cases are written side by side."""
    found = Cases.from_tables(spark, a.store, a.fields or None, _slice(a.frames) if a.frames else None, a.mirror)
    found.to_tables(a.output, spark.read.parquet(f"{a.store}/cases").drop("num_frames"))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="gridloom.jobs")
    sub = top.add_subparsers(required=True)

    def add(name, job, *options):
        p = sub.add_parser(name, help=job.__doc__)
        p.add_argument("store")
        p.set_defaults(job=job)
        for flags, kw in options:
            p.add_argument(*flags, **kw)

    chosen = (("--fields",), {"nargs": "*"}), (("--frames",), {}), (("--mirror",), {"action": "store_true"})
    add("statistics", statistics_job, (("--split",), {}), (("--output",), {"required": True}))
    add("check", check_job, *chosen)
    add("convert", convert_job, *chosen, (("--output",), {"required": True}))
    add("dmd", dmd_job, (("case",), {}), (("field",), {}), (("--rank",), {"type": int, "default": 20}), (("--output",), {"required": True}))
    add("split", split_job, (("--fractions",), {"nargs": 3, "type": float, "default": [0.8, 0.1, 0.1]}), (("--seed",), {"type": int, "default": 0}), (("--output",), {"required": True}), (("--dry-run",), {"action": "store_true"}))
    args = top.parse_args(argv)
    return args.job(spark or SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
