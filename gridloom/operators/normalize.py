"""Normalization of fields and configurations by dataset statistics."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import positive_or_one, standardize, unstandardize
from gridloom.session import ship_package

SCALINGS = ("min_max", "standard")


@dataclass
class Normalizer:
    """Statistics (a few rows, by field and by config path) and how they are applied. Values pass through a literal-sized
    broadcast join: field and path names are schema-sized, never data-sized."""

    field_stats: dict[str, dict[str, float]]
    config_stats: dict[str, dict[str, float]]
    config_scaling: str = "min_max"
    vector_fields: Sequence[Sequence[str]] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.config_scaling not in SCALINGS:
            raise ValueError(f"unknown scaling of configurations: {self.config_scaling!r}")
        if self.vector_fields and (found := [r.problem for r in vector_problems(self.members(), self.statistics()).collect()]):  # a row a component at most
            raise ValueError("vector fields: " + "; ".join(sorted(found)))

    def members(self) -> DataFrame:
        """(vector, field): the components of each vector field."""
        return SparkSession.active().createDataFrame([(k, n) for k, names in enumerate(self.vector_fields) for n in names], "vector int, field string")

    def statistics(self) -> DataFrame:
        """(field, mean, std)."""
        return SparkSession.active().createDataFrame([(n, float(v["mean"]), float(v["std"])) for n, v in self.field_stats.items()], "field string, mean double, std double")

    def scales(self) -> DataFrame:
        """(field, offset, scale) of every field."""
        return field_scales(self.statistics(), self.members())

    @classmethod
    def from_tables(cls, field_stats: DataFrame, config_stats: DataFrame, **options) -> Normalizer:
        """From statistics tables: one row per field and per path."""
        pick = lambda df, key: {r[key]: {k: r[k] for k in ("count", "mean", "std", "min", "max")} for r in df.collect()}
        return cls(pick(field_stats, "field"), pick(config_stats, "path"), **options)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=4, default=list)

    @classmethod
    def from_json(cls, text: str) -> Normalizer:
        return cls(**json.loads(text))

    def normalize_fields(self, rows: DataFrame) -> DataFrame:
        """rows with vals (or value) scaled and marked so; rows that are marked already are an error."""
        return State.mark(self._apply(rows, standardize), True, _values(rows))

    def unnormalize_fields(self, rows: DataFrame) -> DataFrame:
        """The inverse; rows that aren't marked are an error."""
        return State.mark(self._apply(rows, unstandardize), False, _values(rows))

    def _apply(self, rows: DataFrame, step: Callable) -> DataFrame:
        known = rows.join(F.broadcast(self.scales()), "field", "left")  # a row a field name
        lacking = F.raise_error(F.concat(F.lit("field without statistics: "), F.col("field"))).cast("double")
        offset, scale = F.col("offset"), F.when(F.col("scale").isNull(), lacking).otherwise(F.col("scale"))
        column = _values(rows)
        scaled = F.transform(column, lambda v: step(v, offset, scale)) if column == "vals" else step(F.col(column), offset, scale)
        return known.withColumn(column, scaled.alias(column, metadata=rows.schema[column].metadata)).select(*rows.columns)

    def normalize_config(self, params: DataFrame, inverse: bool = False) -> DataFrame:
        """The long configuration table with every number scaled but the discretization's; strings, bools and plain
        lists pass. A number without statistics is an error that names its path."""
        stats = params.sparkSession.createDataFrame([(k, *(float(v[c]) for c in ("mean", "std", "min", "max"))) for k, v in self.config_stats.items()], "path string, mean double, std double, min double, max double")
        rows = params.withColumn("path", F.concat_ws(".", "grp", "name")).join(F.broadcast(config_scales(stats, self.config_scaling)), "path", "left")
        active = (F.col("kind") == "number") & (F.col("grp") != "discretization")
        fail = F.raise_error(F.concat(F.lit("no statistics for config parameter "), F.col("path"))).cast("double")
        step = unstandardize if inverse else standardize
        value = F.when(active & F.col("scale").isNull(), fail).when(active, step("value", "offset", "scale")).otherwise(F.col("value"))
        return rows.withColumn("value", value).select(*params.columns)

    def forward(self, samples: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """normalize -> model (a mapInArrow function over field lines) -> unnormalize the fields only; configurations
        stay out of the round trip, so they come back bit for bit."""
        ship_package(samples.sparkSession)
        made = self.normalize_fields(samples).mapInArrow(fn, schema)
        return self.unnormalize_fields(State.mark(made, True, _values(made)))


def _values(rows: DataFrame) -> str:
    return "vals" if "vals" in rows.columns else "value"


def vector_problems(members: DataFrame, stats: DataFrame) -> DataFrame:
    """(problem) of (vector, field) components: alone in their vector, there several times, or without statistics."""
    known = members.join(stats.select("field", F.lit(True).alias("known")), "field", "left")
    counted = known.withColumn("alone", F.count("*").over(Window.partitionBy("vector")) < 2).withColumn("shared", F.count("*").over(Window.partitionBy("field")) > 1)
    kinds = (F.col("alone"), " is the only component"), (F.col("shared"), " is there several times"), (F.col("known").isNull(), " has no statistics")
    told = F.filter(F.array(*[F.when(c, F.concat("field", F.lit(t))) for c, t in kinds]), lambda x: x.isNotNull())
    return counted.select(F.explode(told).alias("problem")).distinct()


def field_scales(stats: DataFrame, members: DataFrame) -> DataFrame:
    """(field, offset, scale) from (field, mean, std): the mean and std of a field by itself; the components of a vector keep
    their zero and share the root of their mean square. A scale that isn't positive is 1."""
    parts = members.join(stats, "field")
    rms = F.sqrt(F.avg(F.col("std") * F.col("std") + F.col("mean") * F.col("mean")).over(Window.partitionBy("vector")))
    shared = parts.select("field", rms.alias("rms"))
    both = stats.join(shared, "field", "left")
    return both.select("field", F.expr("CASE WHEN rms IS NULL THEN mean ELSE 0D END").alias("offset"), positive_or_one(F.coalesce("rms", "std")).alias("scale"))


def config_scales(stats: DataFrame, scaling: str = "min_max") -> DataFrame:
    """(path, offset, scale) from (path, mean, std, min, max)."""
    if scaling == "standard":
        return stats.select("path", F.col("mean").alias("offset"), positive_or_one("std").alias("scale"))
    return stats.select("path", ((F.col("min") + F.col("max")) / 2).alias("offset"), positive_or_one((F.col("max") - F.col("min")) / 2).alias("scale"))


class State:
    """A guard that a batch is normalized once and unnormalized once; the flag travels as column metadata."""

    KEY = "is_normalized"

    @classmethod
    def mark(cls, df: DataFrame, normalized: bool, column: str = "vals") -> DataFrame:
        if cls.of(df, column) == normalized:
            raise ValueError(f"the batch is already {'' if normalized else 'un'}normalized")
        return df.withMetadata(column, {cls.KEY: normalized})

    @classmethod
    def of(cls, df: DataFrame, column: str = "vals") -> bool:
        return bool(df.schema[column].metadata.get(cls.KEY, False))
