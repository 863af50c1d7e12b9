"""Training augmentations. Draws are hashes of (seed, sample, axis), so they don't change with the partitioning.

Order: flip, normalize, noise. A normalized configuration has its constant gravity at 0 and couldn't be flipped, and the
negation of a mean-shifted field isn't the normalization of the negated one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import hash_uniform
from gridloom.operators.symmetry import flip_rows, flippable, reflect_heaters, swap_sides


def choose_flips(samples: DataFrame, probability: float = 0.5, seed: int = 0, key: str = "window_id") -> DataFrame:
    """flip_x and flip_y of each sample: a draw below the probability, on axes without gravity."""
    if not 0.0 <= probability <= 1.0:
        raise ValueError(f"a flip probability lies in [0, 1], not {probability}")
    free = samples.withColumn("__free", flippable())
    draw = lambda axis: hash_uniform(seed, key, F.lit(axis)) < F.lit(probability)
    return free.withColumn("flip_x", F.col("__free.x") & draw("x")).withColumn("flip_y", F.col("__free.y") & draw("y")).drop("__free")


def flip_augmentation(rows: DataFrame, probability: float = 0.5, seed: int = 0, training: bool = True, key: str = "window_id") -> DataFrame:
    """Input and target lines of a sample share its flips. rows carry gravx, gravy, gravz and ny."""
    if not training or probability == 0:
        return rows
    return flip_rows(choose_flips(rows, probability, seed, key)).drop("flip_x", "flip_y")


def flip_samples(rows: DataFrame, heaters: DataFrame, sides: DataFrame, probability: float = 0.5, seed: int = 0, training: bool = True, key: str = "window_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples with their configurations: the lines, heaters and boundaries of a sample share its flips.

    rows carry gravx, gravy, gravz and ny; heaters (key, x_min, x_max, y_min, y_max, xMin, xMax, yMin, yMax, nuc_sites_x,
    nuc_sites_y); sides (key, left_type, right_type, bottom_type, top_type)."""
    if not training or probability == 0:
        return rows, heaters, sides
    drawn = choose_flips(rows.select(key, "gravx", "gravy", "gravz").distinct(), probability, seed, key).select(key, "flip_x", "flip_y")
    rows, heaters, sides = (t.join(drawn, key) for t in (rows, heaters, sides))
    for axis in "xy":
        heaters = reflect_heaters(heaters, axis, f"{axis}_min", f"{axis}_max", f"flip_{axis}")
        sides = swap_sides(sides, axis, f"flip_{axis}")
    return tuple(t.drop("flip_x", "flip_y") for t in (flip_rows(rows), heaters, sides))


def noise_std(low: float, high: float, seed: int, key: str):
    """A log-uniform std for each sample."""
    if not 0 < low <= high:
        raise ValueError(f"noise bounds must be positive and ordered, not {low}, {high}")
    return F.exp(F.lit(math.log(low)) + hash_uniform(seed, key) * F.lit(math.log(high) - math.log(low)))


def noise_augmentation(rows: DataFrame, low: float, high: float, seed: int = 0, fields: list[str] | None = None, training: bool = True, normalized: bool = True, key: str = "window_id") -> DataFrame:
    """Gaussian noise on the input lines (part = 'input'), one std per sample; needs normalized input. Each value's
    normal draw comes from two hashed uniforms (Box-Muller), so it depends on the cell alone."""
    if not normalized:
        raise ValueError("noise is added to normalized fields")
    if not training:
        return rows
    std = noise_std(low, high, seed, key)
    chosen = (F.col("part") == "input") & (F.col("field").isin(fields) if fields is not None else F.lit(True))
    at = [key, "field", "frame", "j"]

    def noisy(v, i):
        u = F.greatest(hash_uniform(seed + 1, *at, i), F.lit(2.0**-53))
        return v + std * F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * hash_uniform(seed + 2, *at, i))

    return rows.withColumn("vals", F.when(chosen, F.transform("vals", noisy)).otherwise(F.col("vals")))


def compose(rows: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], training: bool = True) -> DataFrame:
    """The steps in order while training."""
    for step in steps if training else []:
        rows = rows.transform(step)
    return rows
