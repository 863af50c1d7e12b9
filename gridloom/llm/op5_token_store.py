"""Content-addressed token-id store: rolling-hash chunks, unique payloads, document recipes, Merkle manifests.

Write: texts are encoded, the end id is appended, and a rolling hash over the last 8 ids cuts each document's id
stream where its low bits are zero (about every 512 ids, at most MAX_CHUNK), so equal passages give equal chunks
wherever they stand. A chunk's address is the 16-byte BLAKE2b of its little-endian ids. The store folder holds
  chunks/   address, payload (zstd over the ids), each address once;
  recipes/  shard, idx, doc_id, start, n_tokens, addresses: range-partitioned and sorted by doc_id;
  manifest/ shard, docs, tokens, first_start, root (Merkle root over the recipes' leaves, in order).
Read: each payload is decompressed, its address recomputed, its crc taken once; recipes join chunks by address and
the document's crc is combined from its chunks' crcs (the GF(2) rule of crc32), so payloads never travel again.
verify() recomputes the Merkle roots and counts from the recipes read back and compares them with the manifest;
store_digests() calls it first and raises if they differ.

Cases: a null or empty text is the end id alone; documents with equal ids keep a row each (rows are told apart by
shard and idx; equal doc_ids follow one another in unspecified order); a null doc_id sorts first; an empty table
gives an empty store. A hot chunk is sent at most once by each task before the exchange.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import _LANE, Words, _mix, dealt, map_arrow, shared_dir, span_hashes, text_chunks, text_only

END_ID = 2
CUT_MASK = np.uint64(511)
MAX_CHUNK = 8192
WORD_CACHE = 1_200_000
ENCODE_BYTES = 2 << 20
SENT = 200_000
ADDRESS = 16


_KIND = np.full(256, 3, dtype=np.uint8)  # 0 white, 1 ASCII letter, 2 sign, 3 anything else
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[65:91], _KIND[97:123] = 0, 1, 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2


def split_pieces(data: np.ndarray, offsets: np.ndarray):
    """(bytes, starts, ends, plain, first piece of each text) of words cut into what the tokenizer encodes by itself.

    A word of ASCII or Latin-1 letters with signs after it is two of the tokenizer's pieces, the letters in lower case
    (plain) and the signs; any other word stays whole, its case as it is."""
    words = Words(data, offsets, None)
    start, stop = words.start, words.stop
    before, after = np.zeros_like(data), np.zeros_like(data)
    before[1:], after[:-1] = data[:-1], data[1:]
    latin = lambda b: (b >= 0x80) & (b <= 0xBF) & (b != 0x97) & (b != 0xB7)  # noqa: E731  after a byte 0xC3
    tail = (before == 0xC3) & latin(data)
    kind = _KIND[data]
    kind[tail | (data == 0xC3) & latin(after)] = 1
    total = lambda mask: np.append(0, np.cumsum(mask, dtype=np.int64))
    signs, other = total(kind == 2), total(kind == 3)
    n = signs[stop] - signs[start]
    simple = (other[stop] == other[start]) & (n < stop - start) & (signs[stop] - signs[stop - n] == n)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[start[simple]] += 1
    inside[stop[simple]] -= 1
    upper = (data >= 65) & (data <= 90) | tail & (data <= 0x9E)
    data = data + (upper & (np.cumsum(inside[:-1], dtype=np.int8) > 0)) * np.uint8(32)
    split = simple & (n > 0)
    ends = np.cumsum(1 + split)
    starts, stops, plain = np.repeat(start, 1 + split), np.repeat(stop, 1 + split), np.repeat(simple, 1 + split)
    second = ends[split] - 1
    starts[second] = stops[second - 1] = (stop - n)[split]
    plain[second] = False
    return data, starts, stops, plain, np.append(0, ends)[words.first]


class _Encoder:
    """Ids of whole texts. The tokenizer drops white space and never joins across it, so the pieces of split_pieces are
    encoded once each and kept by a 64-bit hash of their bytes (a bounded table). Plain pieces are encoded many at a
    time, told apart by the mark every piece's last token bears."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("the store keeps ids in 16 bits")
        self.ends = np.zeros(65536, dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """An empty table: hash -> place, with each place's ids in one arena. Place 0 is the end id."""
        self.place: dict[int, int] = {}
        self.arena, self.used = np.full(1 << 16, END_ID, dtype=np.uint16), 1
        self.first, self.count = np.zeros(1 << 14, dtype=np.int64), np.ones(1 << 14, dtype=np.int64)

    def _one_by_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], dtype=np.uint16), np.array([len(x) for x in ids], dtype=np.int64)

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode(b" ".join(pieces).decode(), add_special_tokens=False).ids, dtype=np.uint16)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):  # a vocabulary without such marks
            return self._one_by_one(pieces)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        at, m = len(self.place) + 1, len(hashes)
        while len(self.first) < at + m:
            self.first, self.count = np.append(self.first, self.first), np.append(self.count, self.count)
        while len(self.arena) < self.used + len(ids):
            self.arena = np.append(self.arena, self.arena)
        self.arena[self.used : self.used + len(ids)] = ids
        self.count[at : at + m] = count
        self.first[at : at + m] = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.place.update(zip(hashes.tolist(), range(at, at + m), strict=True))

    def encode(self, column: pa.Array):
        """(first row, end row, ids of those texts end to end, number of each) in parts."""
        for lo, hi, data, offsets in text_chunks(column, ENCODE_BYTES):
            data, start, stop, plain, border = split_pieces(data, offsets)
            unique, at, inverse = np.unique(span_hashes(data, start, stop), return_index=True, return_inverse=True)
            if len(self.place) > WORD_CACHE:
                self._forget()
            places = np.fromiter(map(self.place.get, unique.tolist(), repeat(0)), dtype=np.int64, count=len(unique))
            raw = data.tobytes()
            for group, encode, most in ((plain[at], self._together, 4000), (~plain[at], self._one_by_one, 100_000)):
                new = np.flatnonzero((places == 0) & group)
                for k in range(0, len(new), most):
                    part = new[k : k + most]
                    self._learn(unique[part], *encode([raw[a:b] for a, b in zip(start[at[part]].tolist(), stop[at[part]].tolist(), strict=True)]))
                places[new] = np.arange(len(self.place) + 1 - len(new), len(self.place) + 1)
            used = np.insert(places[inverse], border[1:], 0)  # each text's end id
            count = self.count[used]
            ends = np.cumsum(count)
            ids = self.arena[np.repeat(self.first[used] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
            yield lo, hi, ids, np.diff(ends[border[1:] + np.arange(hi - lo)], prepend=0)


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


@lru_cache(maxsize=1)
def _id_values() -> np.ndarray:
    return _mix((np.arange(65536, dtype=np.uint64) + np.uint64(1)) * _LANE[20])


def cut_points(ids: np.ndarray, size: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each id stream, the streams end to end in ids. No cut falls within a stream's first 7 ids, so the 8 ids a cut looks
    at are always the stream's own."""
    mixed = _id_values()[ids]
    rolling = mixed * _LANE[21]
    for back in range(1, min(8, len(ids))):
        rolling[back:] += mixed[:-back] * _LANE[21 + back]
    at = np.flatnonzero((rolling >> np.uint64(40)) & CUT_MASK == 0) + 1
    last = np.cumsum(size)
    of = np.searchsorted(last, at - 1, side="right")
    inner = at - (last[of] - size[of]) if len(at) else at
    keep = (inner >= 8) & (inner < size[of]) if len(at) else at.astype(bool)
    of, inner = of[keep], inner[keep]
    border = np.searchsorted(of, np.arange(len(size) + 1))
    out = []
    for i, n in enumerate(size.tolist()):
        ends, lo = [], 0
        for hi in [*inner[border[i] : border[i + 1]].tolist(), n]:
            while hi - lo > MAX_CHUNK:
                lo += MAX_CHUNK
                ends.append(lo)
            ends.append(hi)
            lo = hi
        out.append(ends)
    return out


_RAW = "kind int, bucket int, doc_id long, n_tokens long, addresses binary, payload binary"


def _encode_rows(tokenizer_path: str):
    def run(batches):
        coder, press, sent = _encoder(tokenizer_path), zstandard.ZstdCompressor(level=1), set()
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for start, end, ids, size in coder.encode(b.column("text")):
                rows, base = [], 0
                for doc_id, n, cuts in zip(doc_ids[start:end], size.tolist(), cut_points(ids, size), strict=True):
                    lo, addresses = base, []
                    for cut in cuts:
                        raw = ids[lo : base + cut].tobytes()
                        address = hashlib.blake2b(raw, digest_size=ADDRESS).digest()
                        addresses.append(address)
                        if address not in sent:
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(address)
                            rows.append((1, int.from_bytes(address[:4], "little") >> 1, None, None, address, press.compress(raw)))
                        lo = base + cut
                    base += n
                    joined = b"".join(addresses)
                    rows.append((0, zlib.crc32(joined + str(doc_id).encode()) >> 1, doc_id, n, joined, None))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "bucket", "doc_id", "n_tokens", "addresses", "payload"])

    return run


def _unique_chunks(batches):
    """Drops the repeats of an address within a partition; equal addresses share one."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for kind, address in zip(b.column("kind").to_pylist(), b.column("addresses").to_pylist(), strict=True):
            keep.append(not kind or address not in seen)
            if kind:
                seen.add(address)
        yield b.filter(pa.array(keep, pa.bool_()))


def _leaf(doc_id: int | None, addresses: bytes) -> bytes:
    return hashlib.blake2b(str(doc_id).encode() + b"|" + addresses, digest_size=32).digest()


class Merkle:
    """Root over leaves that come in order, with one pending node for each level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for i, pending in enumerate(self.levels):
            if pending is None:
                self.levels[i] = node
                return
            node = hashlib.blake2b(pending + node, digest_size=32).digest()
            self.levels[i] = None
        self.levels.append(node)

    def root(self) -> bytes:
        node = b""
        for pending in self.levels:
            if pending is not None:
                node = pending if not node else hashlib.blake2b(pending + node, digest_size=32).digest()
        return node


def _order(batches):
    """Sorted partition -> recipes with their start within the shard, and at the end the shard's manifest row."""
    shard, start, idx, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
    names = ["manifest", "shard", "idx", "doc_id", "start", "n_tokens", "addresses"]
    kinds = (pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for b in batches:
        ids, sizes, addresses = (b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "addresses"))
        n = np.array(sizes, dtype=np.int64)
        starts = start + np.cumsum(n) - n
        for d, a in zip(ids, addresses, strict=True):
            tree.add(_leaf(d, a))
        cols = ([False] * len(n), [shard] * len(n), range(idx, idx + len(n)), ids, starts.tolist(), sizes, addresses)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        idx, start = idx + len(n), start + int(n.sum())
    if idx:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((True, shard, idx, None, None, start, tree.root()), kinds, strict=True)], names=names)


def write_store(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> str:
    """Encodes docs into a store folder (by default in the shared folder) and returns its path."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token_store/{uuid.uuid4().hex}"
    raw = map_arrow(text_only(docs), _encode_rows(tokenizer_path), _RAW)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    map_arrow(dealt(raw, "bucket"), _unique_chunks, _RAW).drop("bucket").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.schema("doc_id long, n_tokens long, addresses binary, payload binary, kind int").parquet(f"{path}/raw")
    recipes = raw.where("kind = 0").select("doc_id", "n_tokens", "addresses")
    ordered = map_arrow(recipes.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id"), _order, "manifest boolean, shard int, idx long, doc_id long, start long, n_tokens long, addresses binary")
    ordered.write.partitionBy("manifest").parquet(f"{path}/ordered")
    return path


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """(shard, idx, doc_id, start, n_tokens, addresses): start counts the ids of all documents before it."""
    ordered = spark.read.schema("shard int, idx long, doc_id long, start long, n_tokens long, addresses binary, manifest boolean").parquet(f"{path}/ordered")
    shards = ordered.where("manifest").select("shard", F.col("n_tokens").alias("tokens")).orderBy("shard").collect()  # one row a partition
    before, total = [], 0
    for r in shards:
        before.append((r.shard, total))
        total += r.tokens
    offset = spark.createDataFrame(before, "shard int, before long")
    return ordered.where("NOT manifest").join(F.broadcast(offset), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before", "manifest")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(address, n, crc) of every stored chunk, each checked against its address."""

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for b in batches:
            n, crc = [], []
            for address, payload in zip(b.column("addresses").to_pylist(), b.column("payload").to_pylist(), strict=True):
                raw = press.decompress(payload)
                if hashlib.blake2b(raw, digest_size=ADDRESS).digest() != address:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                n.append(len(raw) // 2)
                crc.append(zlib.crc32(np.frombuffer(raw, dtype=np.uint16).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("addresses"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["address", "n", "crc"])

    raw = spark.read.schema("doc_id long, n_tokens long, addresses binary, payload binary, kind int").parquet(f"{path}/raw")
    return map_arrow(raw.where("kind = 1").select("addresses", "payload"), run, "address binary, n long, crc long")


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """[power, byte, value]: what 2**power zero bytes make of each byte of a crc32 (polynomial 0xEDB88320)."""
    column = np.zeros(32, dtype=np.uint32)  # one zero bit
    column[0] = 0xEDB88320
    column[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)

    def times(matrix, values):
        out = np.zeros_like(values)
        for bit in range(32):
            out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0)).astype(np.uint32)
        return out

    for _ in range(3):  # one zero byte
        column = times(column, column)
    tables = []
    for _ in range(40):
        tables.append([times(column, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])
        column = times(column, column)
    return np.array(tables)


def combine_crc(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings end to end from their crc32s and the second's length, for whole arrays."""
    t, out = _shift_tables(), first.astype(np.uint32)
    for power in range(int(second_bytes.max(initial=0)).bit_length()):
        moved = t[power, 0][out & 255] ^ t[power, 1][out >> 8 & 255] ^ t[power, 2][out >> 16 & 255] ^ t[power, 3][out >> 24]
        out = np.where(second_bytes >> power & 1, moved, out)
    return out ^ second.astype(np.uint32)


def _digests(batches):
    for b in batches:
        parts = b.column("parts")
        size = pa.compute.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        flat = parts.flatten()
        pos, n, crc = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "n", "crc"))
        order = np.lexsort((pos, np.repeat(np.arange(len(size)), size)))
        n, crc = n[order], crc[order]
        out, total = np.zeros(len(size), dtype=np.uint32), np.zeros(len(size), dtype=np.int64)
        for j in range(int(size.max(initial=0))):
            rows = np.flatnonzero(size > j)
            at = first[rows] + j
            out[rows] = combine_crc(out[rows], crc[at], n[at] * 4)
            total[rows] += n[at]
        if not np.array_equal(total, b.column("n_tokens").to_numpy()):
            raise ValueError("a recipe's chunks don't make up its ids")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(out.astype(np.int64)), b.column("n_chunks")], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])


def store_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks), all from the files of a store, whose manifest is verified first."""
    if not verify(spark, path):
        raise ValueError("the recipes differ from the store's manifest")
    recipes = read_recipes(spark, path).withColumn("n_chunks", F.expr(f"cast(length(addresses) / {ADDRESS} as long)"))
    split = f"transform(sequence(0, cast(n_chunks as int) - 1), i -> substring(addresses, i * {ADDRESS} + 1, {ADDRESS}))"
    used = recipes.select("shard", "idx", F.posexplode(F.expr(split)).alias("pos", "address"))
    found = used.join(read_chunks(spark, path), "address").groupBy("shard", "idx").agg(F.collect_list(F.struct("pos", "n", "crc")).alias("parts"))
    whole = recipes.drop("addresses").join(found, ["shard", "idx"], "left").withColumn("parts", F.expr("coalesce(parts, array())"))
    return map_arrow(whole.select("doc_id", "start", "n_tokens", "n_chunks", "parts"), _digests, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>): the id streams rebuilt from the store, in full."""
    recipes = read_recipes(spark, path)
    split = f"transform(sequence(0, cast(length(addresses) / {ADDRESS} as int) - 1), i -> substring(addresses, i * {ADDRESS} + 1, {ADDRESS}))"
    raw = spark.read.schema("doc_id long, n_tokens long, addresses binary, payload binary, kind int").parquet(f"{path}/raw").where("kind = 1")
    used = recipes.select("shard", "idx", F.posexplode(F.expr(split)).alias("pos", "address")).join(raw.select(F.col("addresses").alias("address"), "payload"), "address")
    parts = used.groupBy("shard", "idx").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("parts"))

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for b in batches:
            ids = [np.frombuffer(b"".join(press.decompress(p["payload"]) for p in x), dtype=np.uint16).astype(np.int32) for x in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return map_arrow(recipes.select("shard", "idx", "doc_id", "start").join(parts, ["shard", "idx"]).select("doc_id", "start", "parts"), run, "doc_id long, start long, ids array<int>")


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the recipes on disk still give every shard's Merkle root, document count and token count, in place."""
    ordered = spark.read.schema("shard int, idx long, doc_id long, start long, n_tokens long, addresses binary, manifest boolean").parquet(f"{path}/ordered")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        shard, tree, docs, tokens, placed, seen = None, Merkle(), 0, 0, True, []
        for b in batches:
            for s, i, d, at, n, a in zip(*(b.column(c).to_pylist() for c in ("shard", "idx", "doc_id", "start", "n_tokens", "addresses")), strict=True):
                if s != shard and shard is not None:
                    seen.append((shard, tree.root(), docs, tokens, placed))
                    tree, docs, tokens, placed = Merkle(), 0, 0, True
                shard, placed = s, placed and (i, at) == (docs, tokens)
                tree.add(_leaf(d, a))
                docs, tokens = docs + 1, tokens + n
        if shard is not None:
            seen.append((shard, tree.root(), docs, tokens, placed))
        cols, kinds = list(zip(*seen, strict=True)) or [()] * 5, (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "again", "docs", "tokens", "placed"])

    rows = ordered.where("NOT manifest").select("shard", "idx", "doc_id", "start", "n_tokens", "addresses")
    again = map_arrow(rows.repartition(parts, "shard").sortWithinPartitions("shard", "idx"), run, "shard int, again binary, docs long, tokens long, placed boolean")
    stated = ordered.where("manifest").select("shard", F.col("addresses").alias("root"), "idx", "n_tokens")
    right = "coalesce(root = again AND idx = docs AND n_tokens = tokens AND placed, false)"
    return stated.join(again, "shard", "full_outer").where(f"NOT {right}").isEmpty()


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return store_digests(spark, path)
