"""Assembly of block-structured dumps into grid lines.

blocks: (case_id, frame, field, block, row, col, n_rows, n_cols, data array<array<double>>) with a block's place in the
grid of blocks. Lines of one grid row meet by (case, frame, field, j) and are put end to end in block order: one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import init
from gridloom.functions.fixed import FIELD_NAMES, X_FACE, Y_FACE


def block_places(layout: DataFrame) -> DataFrame:
    """(case_id, block, row, col, n_rows, n_cols, place) from (case_id, block, level, dimensionality, x_low, x_high, y_low,
    y_high, n_cols, n_rows). Three dimensions, refined blocks, or a number of blocks that doesn't fill the grid are errors."""
    w = Window.partitionBy("case_id")
    lo_x, hi_x, lo_y, hi_y = F.min("x_low").over(w), F.max("x_high").over(w), F.min("y_low").over(w), F.max("y_high").over(w)
    fail = lambda text: F.raise_error(F.lit(text)).cast("int")
    col = F.rint((F.col("x_low") - lo_x) / ((hi_x - lo_x) / F.col("n_cols"))).cast("int")
    row = F.rint((F.col("y_low") - lo_y) / ((hi_y - lo_y) / F.col("n_rows"))).cast("int")
    guard = F.when(F.col("dimensionality") != 2, fail("only two-dimensional dumps are read")).when(F.max("level").over(w) != 1, fail("refined blocks lie on no single grid")).when(F.count("*").over(w) != F.col("n_cols") * F.col("n_rows"), fail("the blocks don't fill their grid"))
    placed = layout.select("*", row.alias("row"), guard.otherwise(col).alias("col"))
    return placed.select("case_id", "block", "row", "col", "n_rows", "n_cols", (F.col("row") * F.col("n_cols") + F.col("col")).alias("place"))


def renamed(variable) -> Column:
    """A solver variable's field name; unknown names stay, without the spaces that pad them."""
    names = F.create_map(*[F.lit(x) for kv in FIELD_NAMES.items() for x in kv])
    return F.coalesce(names[F.trim(variable)], F.trim(variable))


def assemble(blocks: DataFrame) -> DataFrame:
    """field_rows (case_id, field, frame, j, vals). A face that two blocks share is stored by both: x faces keep the high
    face of the last block column only, y faces that of the last block row only."""
    lines = blocks.select("*", F.posexplode("data").alias("jb", "line"))
    last_row = F.col("row") == F.col("n_rows") - 1
    height = F.size("data") - F.when(F.col("field") == Y_FACE, 1).otherwise(0)
    own = lines.where((F.col("field") != Y_FACE) | (F.col("jb") < height) | last_row)
    drop_high = (F.col("field") == X_FACE) & (F.col("col") < F.col("n_cols") - 1)
    part = own.select("case_id", "field", "frame", (F.col("row") * height + F.col("jb")).alias("j"), "col", F.when(drop_high, init(F.col("line"))).otherwise(F.col("line")).alias("line"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("col", "line"))), lambda s: s["line"]))
    return part.groupBy("case_id", "field", "frame", "j").agg(joined.alias("vals"))


def incomplete_frames(blocks: DataFrame) -> DataFrame:
    """(case_id, frame, field): variables of a case's first frame that another of its frames lacks."""
    have = blocks.select("case_id", "frame", "field").distinct()
    first = have.join(have.groupBy("case_id").agg(F.min("frame").alias("frame")), ["case_id", "frame"], "left_semi").select("case_id", "field")
    return have.select("case_id", "frame").distinct().join(first, "case_id").join(have, ["case_id", "frame", "field"], "left_anti")
