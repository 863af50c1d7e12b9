"""What the training-data operators share: shared-folder tables, word kernels, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import ship_package

#: Fixed seeds of the 64-bit hashes; changing them changes ids but no result.
BYTE_SEED, ORDER_SEED = 20240117, 77001
#: Bytes of text that a kernel turns into arrays at a time (a longer document goes alone).
CHUNK_BYTES = 1 << 20


#: Spark's own setting for shuffle files to go when an execution ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys are hot that hold more than one of HOT_KEYS parts of all rows: fewer than HOT_KEYS keys, however many rows.
HOT_KEYS = 1000
#: Rows of a file, and files at least, of a narrow scratch table of known length.
FILE_ROWS, FEWEST = 10_000, 4


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is set, a temporary one if everything runs on
    this machine, and an error on a cluster, whose executors don't share one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if not conf and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="gridloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def table(df: DataFrame, *partition_by: str, rows: int | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read back: a lineage cut that survives lost executors. The shuffle
    files of the writing go with it. rows: of a narrow table, if known, how many there are at most; then one task writes
    each FILE_ROWS of them (FEWEST files at least), however many shuffle partitions there are."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(FEWEST, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of table() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(big: DataFrame, small: DataFrame, on: str | list[str], n: str) -> DataFrame:
    """Inner join where `small`, a written table, has one row a key and says in its column n how many rows of `big` hold
    the key. The rows of hot keys stay where they are, as their few rows of small (fewer than HOT_KEYS) are broadcast;
    in the shuffle of the others no key holds more than one of HOT_KEYS parts of the rows."""
    on = [on] if isinstance(on, str) else on
    limit = (small.agg(F.sum(n)).first()[0] or 0) / HOT_KEYS
    hot = small.where(F.col(n) > limit)
    cold = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.where(F.col(n) <= limit), on)
    return big.join(F.broadcast(hot), on).unionByName(cold)


def text_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts empty; whatever else the table holds is pruned at the scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than needed to know."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_checked(big: DataFrame, small: DataFrame, on, how: str, max_rows: int = 500_000) -> DataFrame:
    """Join that broadcasts `small` only if it was counted to have at most max_rows (narrow) rows; else both sides shuffle."""
    return big.join(F.broadcast(small) if small_enough(small, max_rows) else small, on, how)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_RNG = np.random.default_rng(BYTE_SEED)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LANE = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII signs.
WORD_BREAKS = _SEP.copy()
WORD_BREAKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i < n, kept per process."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW[:] = out
    return _POW[0], _POW[1]


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit ids of byte spans: polynomial sums over random values of the bytes, length added, finalised."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return _mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


class Words:
    """The words of some whole texts as arrays: byte spans, 64-bit ids, and each document's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool | None, separators: np.ndarray = _SEP):
        """lower: whether A-Z count as a-z; None leaves the ids out."""
        sep = separators[data]
        start = ~sep
        start[1:] &= sep[:-1] | False
        stop = ~sep
        stop[:-1] &= sep[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]  # texts lie end to end: cut words there
        start[inner] = ~sep[inner]
        stop[inner - 1] = ~sep[inner - 1]
        self.start, self.stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each text, and the end
        if lower is not None:
            self.hash = span_hashes(_LOWER[data] if lower else data, self.start, self.stop)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words at each word, and whether they lie in one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out[: n - k + 1] += self.hash[j : n - k + 1 + j] * _LANE[j]
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        inside = np.zeros(n, dtype=bool)
        inside[: n - k + 1] = doc[k - 1 :] == doc[: n - k + 1]
        return _mix(out), inside


def sequence_hash(words: np.ndarray, lane: int = 0) -> int:
    """64 bits of a whole word sequence, its length included."""
    up, _ = _powers(len(words) + 1)
    value = (words * up[1 : len(words) + 1]).sum(dtype=np.uint64, keepdims=True) * _LANE[40 + lane] + np.uint64(len(words))
    return int(_mix(value + _LANE[50 + lane])[0])


def set_hash(unique: np.ndarray, lane: int = 0) -> int:
    """64 bits of a set of 64-bit ids."""
    mixed = _mix((unique + _LANE[42 + lane]) * _LANE[44 + lane])
    return int(_mix(mixed.sum(dtype=np.uint64, keepdims=True) + np.array([len(unique)], dtype=np.uint64) * _LANE[46 + lane])[0])


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a string column in pieces of about limit bytes, documents whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


#: Bytes of an Arrow batch, unless the session names a number of its own.
BATCH_BYTES = "16m"


def _give_back() -> None:
    """Returns what a finished task left free in a worker, which stays for the next task, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def prepare(spark: SparkSession) -> None:
    """The package on the workers, and Arrow batches of a bounded size even where every text is very long."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64MB"):
        spark.conf.set(key, BATCH_BYTES)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow whose function may import this package on the executors."""
    prepare(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Blobs dealt by a hashed bucket number over the session's shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
