"""Benchmark decontamination by spaced-seed hashing.

Words are runs without white space or ASCII signs, in lower case (Unicode). Each fixed mask picks the kept positions of a span of words and
ignores the others, so a seed survives substitutions at the ignored ones. The masks of an item length cover its rule:
whichever words of a window are substituted, up to the share allowed, some mask fits in the window with all kept words
equal, so no passage of the rule goes unseen (a test tries all patterns). The seeds of all benchmark items form a
sorted hash table; every seed of every document is looked up there (a bitmap first), and each hit fixes a diagonal
(document position minus item position). On it the whole item is compared word by word: the item is leaked if some
window of min(WINDOW, item length) words has at least MIN_SHARE equal words.

The benchmark is the stated query set. It goes out in blocks of about BLOCK_ITEMS items (counted first), one pass over
the documents for each block. Between blocks what is found so far is written to the shared folder and the block's
broadcast destroyed, so no process ever holds more than one block. Documents don't shuffle. Hits are compared in pieces,
so a seed that many items and words share costs time, not memory.

Cases: a null or empty text leaks nothing; rows with a null doc_id are judged like others; items of fewer than MIN_WORDS words match nothing; equal items are all reported; no benchmark rows, no leak; repeated
documents give repeated results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import _LANE, WORD_BREAKS, Words, _mix, drop, map_arrow, table, text_chunks, text_only

# Fixed masks by window length (1 counts, 0 is ignored): each family covers all substitutions that MIN_SHARE allows.
MASKS = {
    4: ("111", "1101", "1011"),
    5: ("111", "1101"),
    6: ("1111", "11011"),
    7: ("11111", "111011", "110111"),
    8: ("11011", "1111", "1100011"),
    9: ("111011", "1001111", "11010011", "111101"),
    10: ("111011", "11010011", "11111"),
    11: ("1101011", "1110011"),
    12: ("111011", "110100011", "11001011", "110111"),
    13: ("111011", "1100001011", "110111"),
}
WINDOW, MIN_SHARE, MIN_WORDS = 13, 0.75, 4
BLOCK_ITEMS = 20_000
BITMAP_BITS = 22
#: Hits and words that are compared at a time.
SLICE = 1 << 20


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each position where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, len(mask), dtype=np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out += words[j : j + n] * _LANE[j]
    return _mix(out)


def _words(column: pa.Array):
    """(first row, words) of a string column in parts."""
    for first, _, data, offsets in text_chunks(pc.utf8_lower(column)):
        yield first, Words(data, offsets, lower=False, separators=WORD_BREAKS)


def _slices(n: np.ndarray):
    """(first, end) of runs of n whose sums are about SLICE, each of one at least."""
    sums, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + SLICE, side="right")))
        yield at, end
        at = end


class SeedIndex:
    """Seed tables of some benchmark items, by mask."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        seeds: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item_id, text in items:
            words = next((w.hash for _, w in _words(pa.array([text or ""]))), np.zeros(0, dtype=np.uint64))
            if len(words) < MIN_WORDS:
                continue
            for mask in MASKS[min(WINDOW, len(words))]:
                h = _seeds(words, mask)
                seeds.setdefault(mask, []).append((h, np.full(len(h), len(self.ids)), np.arange(len(h))))
            self.ids.append(item_id)
            self.words.append(words)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([*self.words, np.zeros(0, dtype=np.uint64)])
        self.tables = {}
        for mask, parts in seeds.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
            bitmap[h >> np.uint64(64 - BITMAP_BITS)] = True
            self.tables[mask] = (h[order], item[order], at[order], bitmap)

    def leaks(self, column: pa.Array) -> list[dict[int, float]]:
        """For each text the leaked items with their best window share."""
        out: list[dict[int, float]] = [{} for _ in range(len(column))]
        for first, words in _words(column):
            for mask in self.tables:
                for found in self._diagonals(words, mask):
                    for lo, hi in _slices(self.size[found[:, 1]]):
                        shares = self._shares(words, *found[lo:hi].T)
                        for k in np.flatnonzero(shares >= MIN_SHARE):
                            best, item_id = out[first + int(found[lo + k, 0])], self.ids[found[lo + k, 1]]
                            best[item_id] = max(best.get(item_id, 0.0), float(shares[k]))
        return out

    def _diagonals(self, words: Words, mask: str):
        """(document, item, shift) of the mask's hits in pieces, within each piece once."""
        h, item, at, bitmap = self.tables[mask]
        seeds = _seeds(words.hash, mask)
        maybe = np.flatnonzero(bitmap[seeds >> np.uint64(64 - BITMAP_BITS)])
        lo, hi = np.searchsorted(h, seeds[maybe], "left"), np.searchsorted(h, seeds[maybe], "right")
        maybe, lo, n = maybe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        doc = np.searchsorted(words.first, maybe, side="right") - 1
        for a, b in _slices(n):
            m = n[a:b]
            row = np.repeat(lo[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())
            yield np.unique(np.column_stack([np.repeat(doc[a:b], m), item[row], np.repeat(maybe[a:b], m) - at[row]]), axis=0)

    def _shares(self, words: Words, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The best share of equal words in a window of each item laid over its document at shift."""
        size = self.size[item]
        begin = np.cumsum(size) - size
        k = np.arange(size.sum()) - np.repeat(begin, size)
        at = k + np.repeat(shift, size)
        there = (at >= np.repeat(words.first[doc], size)) & (at < np.repeat(words.first[doc + 1], size))
        equal = np.zeros(len(k) + 1, dtype=np.int64)
        equal[1:][there] = self.flat[(k + np.repeat(self.begin[item], size))[there]] == words.hash[at[there]]
        sums, window = np.cumsum(equal), np.minimum(size, WINDOW)
        fits = k + np.repeat(window, size) <= np.repeat(size, size)  # windows that begin here and end in the item
        inside = np.where(fits, sums[np.minimum(np.arange(len(k)) + np.repeat(window, size), len(k))] - sums[:-1], 0)
        return np.maximum.reduceat(inside, begin) / window


def _each_block(docs: DataFrame, benchmark: DataFrame, block_items: int, step) -> DataFrame:
    """step(docs, broadcast index of a block) for one block of the benchmark after the other."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    blocks, written = max(1, math.ceil(items.count() / block_items * 1.05)), None
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {k}"))
        index = spark.sparkContext.broadcast(SeedIndex([tuple(r) for r in block.collect()]))  # one bounded block
        docs = step(docs, index)
        if k + 1 < blocks:
            docs, before = table(docs), written
            index.destroy()
            if before is not None:
                drop(before)
            written = docs
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, best_share): one row per row of docs."""

    def step(found: DataFrame, index) -> DataFrame:
        def run(batches):
            for b in batches:
                ids, best = [], []
                for leaks, had, share in zip(index.value.leaks(b.column("text")), b.column("item_ids").to_pylist(), b.column("best_share").to_pylist(), strict=True):
                    ids.append(sorted({*had, *leaks}))
                    best.append(max([share, *leaks.values()]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=["doc_id", "text", "item_ids", "best_share"])

        return map_arrow(found, run, "doc_id long, text string, item_ids array<long>, best_share double")

    none = text_only(docs).withColumn("item_ids", F.expr("cast(array() AS array<long>)")).withColumn("best_share", F.lit(0.0))
    out = _each_block(none, benchmark, block_items, step)
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "best_share")


def filter_contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs, all columns as they are, that leak no item."""

    def step(left: DataFrame, index) -> DataFrame:
        def run(batches):
            for b in batches:
                yield b.filter(pa.array([not x for x in index.value.leaks(pc.cast(b.column("text"), pa.string()))], pa.bool_()))

        return map_arrow(left, run, left.schema)

    return _each_block(docs, benchmark, block_items, step)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
