"""Configuration trees: an open-schema VARIANT per case, and the long table operators work on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.fixed import BOUNDARY_KEYS, CONFIG_GROUPS, HEAT_FLUX, HEATER_UNITS, PHYSICAL_UNITS, WALL_TEMP

_NUMBERS = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def parse(df: DataFrame, json_column: str = "config") -> DataFrame:
    """The JSON column as VARIANT."""
    return df.withColumn(json_column, F.parse_json(F.col(json_column)))


def kind_of(v: Column) -> Column:
    """number, string, bool, records (a list of objects), list or group; a bool is no number."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.rlike(_NUMBERS), "number").when(s == "BOOLEAN", "bool").when(s == "STRING", "string")
        .when(s.startswith("ARRAY<OBJECT"), "records").when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "group").otherwise("other")
    )


def config_params(cases: DataFrame) -> DataFrame:
    """(case_id, grp, entry, name, value, kind): every leaf of every case's configuration, two levels deep.

    Groups hold parameters directly; a group that is a list of records (heaters) gives its entries numbers; of a group
    of groups (boundary sides) the inner name is `side.key`."""
    view = cases.select("case_id", F.col("config").alias("__c"))
    top = _explode(view, "__c", ["case_id"], "grp").withColumn("top_kind", kind_of(F.col("v")))
    plain = _explode(top.where("top_kind = 'group'"), "v", ["case_id", "grp"], "name").withColumn("entry", F.lit(0))
    nested = plain.withColumn("k", kind_of(F.col("v"))).where("k = 'group'").withColumnRenamed("name", "side").drop("k")
    inner = _explode(nested, "v", ["case_id", "grp", "entry", "side"], "name").withColumn("name", F.concat_ws(".", "side", "name")).drop("side")
    records = _entries(top.where("top_kind = 'records'"))
    listed = _explode(records, "v", ["case_id", "grp", "entry"], "name")
    flat = plain.unionByName(inner).unionByName(listed).withColumn("kind", kind_of(F.col("v"))).where("kind <> 'group'")
    return flat.select("case_id", "grp", "entry", "name", F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double")).alias("value"), "kind")


def _explode(df: DataFrame, column: str, keep: list[str], key: str) -> DataFrame:
    spark, view = df.sparkSession, df.select(*keep, F.col(column).alias("__v"))
    kept = ", ".join(f"t.{c}" for c in keep)
    return spark.sql(f"SELECT {kept}, e.key AS {key}, e.value AS v FROM {{t}} t, LATERAL variant_explode(t.__v) e", t=view)


def _entries(df: DataFrame) -> DataFrame:
    view = df.select("case_id", "grp", F.col("v").alias("__v"))
    return df.sparkSession.sql("SELECT t.case_id, t.grp, e.pos AS entry, e.value AS v FROM {t} t, LATERAL variant_explode(t.__v) e", t=view)


def heater_rows(cases: DataFrame) -> DataFrame:
    """(case_id, heater, keys, type, xMin, xMax, wall_temp, wall_temp_fraction, nuc_sites_*, nuc_seed_radii) of every heater
    of (case_id, config VARIANT); an absent key is null."""
    top = _explode(cases.select("case_id", F.col("config").alias("__c")), "__c", ["case_id"], "grp").where("grp = 'heaters'")
    entries = _entries(top.where(kind_of(F.col("v")) == "records"))
    named = _explode(entries, "v", ["case_id", "entry"], "name").groupBy("case_id", "entry").agg(F.sort_array(F.collect_set("name")).alias("keys"))
    get = lambda n, kind: F.try_variant_get("v", f"$.{n}", kind).alias(n)
    typed = entries.select("case_id", "entry", get("type", "string"), *[get(n, "double") for n in ("xMin", "xMax", "yMin", "yMax", "wall_temp", "wall_temp_fraction")], *[get(n, "array<double>") for n in ("nuc_sites_x", "nuc_sites_y", "nuc_sites_z", "nuc_seed_radii")])
    return typed.join(named, ["case_id", "entry"]).withColumnRenamed("entry", "heater")


def side_types(cases: DataFrame) -> DataFrame:
    """(case_id, left_type, right_type, bottom_type, top_type) of (case_id, config VARIANT)."""
    return cases.select("case_id", *[F.try_variant_get("config", f"$.boundary.{side}.type", "string").alias(f"{side}_type") for side in ("left", "right", "bottom", "top")])


def upgrade(record: Mapping) -> dict:
    """A configuration record of any age in today's form: boundary types leave the discretization (always, even where
    the side has one), renamed keys get their new names unless both are there, heaters get a type and a wall temperature."""
    out = {g: dict(record.get(g, {})) for g in ("physical", "non_dimensional", "discretization")}
    _rename(out["physical"], "wall_temp", "wall_temp_scale")
    boundary = {side: dict(v) for side, v in record.get("boundary", {}).items()}
    if unknown := sorted(set(boundary) - set(BOUNDARY_KEYS)):
        raise ValueError(f"unknown boundary sides {unknown}")
    for side, key in BOUNDARY_KEYS.items():
        kind = out["discretization"].pop(key, None)
        own = boundary.setdefault(side, {})
        if kind is not None:
            own.setdefault("type", kind)
    heaters = []
    for heater in record.get("heaters", []):
        heater = {"type": WALL_TEMP, **heater}
        _rename(heater, "wallTemp", "wall_temp_fraction")
        if heater["type"] not in (WALL_TEMP, HEAT_FLUX):
            raise ValueError(f"unknown heater type {heater['type']!r}")
        scales = out["physical"].get("bulk_temp"), out["physical"].get("wall_temp_scale")
        if heater["type"] == WALL_TEMP and None not in scales and "wall_temp_fraction" in heater:
            heater.setdefault("wall_temp", float(scales[0]) + float(heater["wall_temp_fraction"]) * (float(scales[1]) - float(scales[0])))
        heaters.append(heater)
    return out | {"heaters": heaters, "boundary": boundary}


def _rename(values: dict, old: str, new: str) -> None:
    if old in values and new not in values:
        values[new] = values.pop(old)


def units(physical_keys: Column) -> Column:
    """Units of the physical parameters present, and of heater parameters always, as a map of maps."""
    known = F.create_map(*[F.lit(x) for kv in PHYSICAL_UNITS.items() for x in kv])
    heater = F.create_map(*[F.lit(x) for kv in HEATER_UNITS.items() for x in kv])
    return F.create_map(F.lit("physical"), F.map_filter(known, lambda k, _: F.array_contains(physical_keys, k)), F.lit("heaters"), heater)


def heater_wall_temp(fraction, bulk, scale) -> Column:
    return F.col(bulk) + F.col(fraction) * (F.col(scale) - F.col(bulk))


def validate_keys(config_keys: Mapping[str, Sequence[str]]) -> None:
    """Driver-side check of a selection {group: names}."""
    if unknown := sorted(set(config_keys) - set(CONFIG_GROUPS)):
        raise ValueError(f"unknown config groups {unknown}")
    for group, names in config_keys.items():
        if isinstance(names, str) or not names:
            raise ValueError(f"config keys of {group!r} must be a non-empty sequence of names")


def missing_keys(params: DataFrame, config_keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """(case_id, path) of every selected key that a case lacks, all at once."""
    validate_keys(config_keys)
    wanted = params.sparkSession.createDataFrame([(g, n) for g, ns in config_keys.items() for n in ns], "grp string, name string")
    every = params.select("case_id").distinct().crossJoin(F.broadcast(wanted))  # the selection: a few names
    return every.join(params, ["case_id", "grp", "name"], "left_anti").select("case_id", F.concat_ws(".", "grp", "name").alias("path"))


def config_matrix(params: DataFrame, config_keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """(case_id, features array<float>): the selected numbers in order. Fails on a selected value that is missing or no
    number, and on a selection from heaters where a case hasn't exactly one."""
    validate_keys(config_keys)
    picked = []
    for group, names in config_keys.items():
        for name in names:
            here = (F.col("grp") == group) & (F.col("name") == name)
            got = F.max(F.when(here & (F.col("kind") == "number"), F.col("value")))
            odd = F.max(F.when(here & (F.col("kind") != "number"), F.lit(1)))
            fail = F.raise_error(F.concat(F.lit(f"{group}.{name} of case "), F.col("case_id").cast("string"), F.lit(" is missing or no number"))).cast("double")
            picked.append((got.alias(f"{group}.{name}"), odd, fail))
    heaters = F.countDistinct(F.when(F.col("grp") == "heaters", F.col("entry"))).alias("__heaters")
    wide = params.groupBy("case_id").agg(*[g for g, _, _ in picked], *[o.alias(f"__odd{i}") for i, (_, o, _) in enumerate(picked)], heaters)
    names = [f"{g}.{n}" for g, ns in config_keys.items() for n in ns]
    values = [F.when(F.col(f"`{n}`").isNull() | F.col(f"__odd{i}").isNotNull(), picked[i][2]).otherwise(F.col(f"`{n}`")).cast("float") for i, n in enumerate(names)]
    out = F.array(*values)
    if "heaters" in config_keys:
        out = F.when(F.col("__heaters") == 1, out).otherwise(F.raise_error(F.lit("a selection from heaters needs exactly one heater")).cast("array<float>"))
    return wide.select("case_id", out.alias("features"))
