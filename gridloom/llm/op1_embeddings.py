"""Embedding near-dedup: int8 tile products with a rigorous error bound for each vector.

Vectors link only within one label (and one dimension). Exactly equal vectors are one class with a multiplicity, so a
hot vector counts once. The classes of a label are dealt into blocks by a hash; every pair of blocks of a label is one
tile, and a tile holds at most two blocks, of int8 codes only. Within a tile:
  x = s*q + e, q int8, |e| computed in double for each unit vector, so
  |cos(x, y) - sx*sy*(qx.qy)| <= |sx*qx|*|ey| + |ex|*|sy*qy| + |ex|*|ey|
where qx.qy is an exact integer (float32 products of 8-bit values stay below 2**24 up to 1000 dimensions, float64 above).
Pairs whose lower bound reaches the threshold link, those whose upper bound stays below don't; the vectors of pairs in
between are fetched in full, by id and tile, and only those pairs are computed again in double precision. A tile gives
each class its number of linked vectors and a spanning forest of its links, never all pairs; link counts add up over
tiles, and components come from the forests. All pairs of a label being compared, tiles grow with its square, at one
byte a component and 2**20 components a block.

Cases: a null vector, one with null or non-finite components, of length zero or norm zero, or with a null label or a null
vec_id links with nothing (0 links, its own component, kept); equal vectors of one label link; rows that share a vec_id
are rows of their own, with the links of their own vector, and count as one id only where components are named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import drop, join_hot, map_arrow, prepare, table
from gridloom.llm.components import connected_components

THRESHOLD = 0.93
#: Components of a block's vectors, and its least and greatest number of vectors.
BLOCK_VALUES, LEAST_BLOCK, MOST_BLOCK = 1 << 20, 128, 4096
SLAB = 128
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the coded vectors and norms of the errors (rounded up)."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1) + 1e-12, np.linalg.norm(unit - coded, axis=1) + 1e-12


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it reaches over the edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        root = new
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    return root


def bounds(t: dict, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosines own x other, from codes alone."""
    kind = np.float32 if t["codes"].shape[1] <= 1000 else np.float64
    near = (t["codes"][own].astype(kind) @ t["codes"][other].astype(kind).T) * (t["scale"][own][:, None] * t["scale"][other])
    apart = t["size"][own][:, None] * t["error"][other] + t["error"][own][:, None] * (t["size"][other] + t["error"][other])
    return near - apart, near + apart


class Links:
    """Linked vectors of each row of a tile, and the forest over its rows."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.count, self.root = copies, np.zeros(len(copies), dtype=np.int64), np.arange(len(copies))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        n = len(self.copies)
        self.count += np.bincount(x, self.copies[y], n).astype(np.int64) + np.bincount(y, self.copies[x], n).astype(np.int64)
        a, b = self.root[x], self.root[y]
        differ = a != b
        if differ.any():
            self.root = forest(n, a[differ], b[differ])[self.root]


def _pairs(t: dict, left: np.ndarray, right: np.ndarray | None, threshold: float):
    """(certain pairs, pairs in doubt) of left x right, or within left if right is None, in slabs."""
    other = left if right is None else right
    for at in range(0, len(left), SLAB):
        own = left[at : at + SLAB]
        low, high = bounds(t, own, other)
        sure, maybe = low >= threshold + SLACK, high >= threshold - SLACK
        out = []
        for mask in (sure, maybe & ~sure):
            i, j = np.nonzero(mask)
            i, j = own[i], other[j]
            out.append((i, j) if right is not None else (i[i < j], j[i < j]))
        yield out


def tile_links(t: dict, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[Links, np.ndarray]:
    """The certain links of a tile, and which of its rows are in pairs in doubt."""
    found, doubt = Links(t["copies"]), np.zeros(len(t["copies"]), dtype=bool)
    for sure, (x, y) in _pairs(t, left, right, threshold):
        found.add(*sure)
        doubt[x] = doubt[y] = True
    return found, doubt


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """vectors, those whose squares would overflow or vanish brought to a greatest component of 1."""
    top = np.abs(vectors).max(axis=1)
    return vectors / np.where((top > 1e100) | (top < 1e-100), top, 1.0)[:, None]


def tile_doubts(t: dict, vectors: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float) -> Links:
    """The links among the pairs in doubt, in double precision."""
    found, vectors = Links(t["copies"]), _scaled(vectors)
    norm = np.linalg.norm(vectors, axis=1)
    for _, (i, j) in _pairs(t, left, right, threshold):
        for lo in range(0, len(i), 1 << 14):
            x, y = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            near = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norm[x] * norm[y]) >= threshold
            found.add(x[near], y[near])
    return found


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(rows, -1)


def _coded(batches):
    """Classes -> their codes, scales, norms and errors."""
    for b in batches:
        vectors, dims = b.column("embedding"), b.column("dim").to_numpy()
        codes, parts = [None] * len(dims), np.zeros((3, len(dims)))
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            x = _scaled(_matrix(vectors.take(pa.array(rows)), len(rows)))
            q, *rest = quantise(x / np.linalg.norm(x, axis=1)[:, None])
            parts[:, rows] = rest
            for k, row in enumerate(rows.tolist()):
                codes[row] = q[k].tobytes()
        keep = ["cid", "label", "dim", "block", "blocks", "copies"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(codes, pa.binary()), *map(pa.array, parts)], names=[*keep, "codes", "scale", "size", "error"])


def _rows(t: pa.Table) -> tuple[pa.Table, dict, np.ndarray, np.ndarray | None]:
    """A tile in the order of its ids: the table, its columns, and the rows of its one or two blocks."""
    t = t.combine_chunks()
    t = t.take(pa.array(np.argsort(t.column("cid").to_numpy(), kind="stable")))
    own = {c: t.column(c).to_numpy() for c in ("cid", "copies", "scale", "size", "error", "block")}
    own["codes"] = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=np.int8).reshape(len(t), -1)
    a, b = t.column("ta")[0].as_py(), t.column("tb")[0].as_py()
    rows = np.arange(len(t))
    return t, own, rows[own["block"] == a], None if a == b else rows[own["block"] == b]


_FOUND = "cid long, links long, root long"


def _sure(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        t, own, left, right = _rows(t)
        found, doubt = tile_links(own, left, right, threshold)
        some = np.flatnonzero((found.count > 0) | doubt)
        at = {c: t.column(c).take(pa.array(some)) for c in ("ta", "tb")}
        return pa.table({"ta": at["ta"], "tb": at["tb"], "cid": own["cid"][some], "links": found.count[some], "root": own["cid"][found.root[some]], "doubt": doubt[some]})

    return run


def _doubtful(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        t, own, left, right = _rows(t)
        found = tile_doubts(own, _matrix(t.column("embedding").combine_chunks(), len(t)), left, right, threshold)
        some = np.flatnonzero(found.count > 0)
        return pa.table({"cid": own["cid"][some], "links": found.count[some], "root": own["cid"][found.root[some]]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors. block: classes of a block, by default by their length."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fits = F.expr("coalesce(label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> coalesce(NOT isnan(x) AND abs(x) <> double('Infinity'), false)) AND exists(embedding, x -> x <> 0) AND vec_id IS NOT NULL, false)")
    hashes = F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "label", "embedding").alias("h2")
    classes = rows.where(fits).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = table(classes.select("*", *hashes, F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("cid")))
    fill = F.lit(block) if block else F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.lit(BLOCK_VALUES) / F.col("dim")))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("m")).select("label", "dim", F.greatest(F.lit(1), F.ceil(F.col("m") / fill)).cast("int").alias("blocks"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("block", F.expr("cast(pmod(h1, blocks) AS int)"))
    kind = rows.schema["label"].dataType.simpleString()
    coded = table(map_arrow(dealt.select("cid", "label", "dim", "block", "blocks", "copies", "embedding"), _coded, f"cid long, label {kind}, dim int, block int, blocks int, copies long, codes binary, scale double, size double, error double"))
    tiles = coded.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("ta", F.least("block", "other")).withColumn("tb", F.greatest("block", "other")).drop("other", "blocks")
    sure = table(tiles.groupBy("label", "dim", "ta", "tb").applyInArrow(_sure(threshold), f"ta int, tb int, {_FOUND}, doubt boolean"))
    asked = sure.where("doubt").select("ta", "tb", "cid").join(coded.drop("blocks"), "cid").join(classes.select("cid", "embedding"), "cid")
    checked = asked.groupBy("label", "dim", "ta", "tb").applyInArrow(_doubtful(threshold), _FOUND)
    found = table(sure.where("links > 0").select("cid", "links", "root").unionByName(checked))
    comps = connected_components(found.select("cid", "root"), "cid", "root")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("cid", "h1", "h2", "least", "copies").join(links, "cid", "left").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    known = table(known.select("h1", "h2", "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")))
    named = table(known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m")))
    whole = table(join_hot(known.drop("least"), named, "component", "m").select("h1", "h2", "copies", "n_links", "component_id"))
    drop(coded, sure, found, known, named, classes)
    own = join_hot(rows.where(fits).select("vec_id", *hashes), whole, ["h1", "h2"], "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fits).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
