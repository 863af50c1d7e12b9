"""Byte-level BPE encoding and decoding as a tree reduction over text halves.

A text is halved until a piece has at most `leaf_chars` characters; leaves are encoded by tiktoken, and two
neighbours are joined by encoding a window around their border again. The window grows until both its ends lie
on a *safe cut*: a position p with no white space before it, a space at it, and no white space after it. No match
of the pattern can span such a p (runs of letters, digits or signs hold no white space and take at most a leading
space; a run of white space can't hold the character before p), so p starts a match in any surrounding text and
the tokens outside the window can't change. That makes joining associative: encoding is a monoid reduction.
Decoding concatenates token bytes up the same tree.

Cases: a null or empty text has no tokens (n_tokens 0, digests of nothing); a text without safe cuts is encoded as
one window; repeated rows give repeated results; other columns of the table are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import map_arrow, text_only

LEAF_CHARS = 2048
FIRST_WINDOW = 16
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder and decoder of one rank file; `reduce` is the tree, `join` the monoid's operation."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.leaf_chars = leaf_chars
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.length = [len(t) for t in self.token]
        self.decimal = [str(i) for i in range(len(self.token))]

    def encode(self, text: str) -> list[int]:
        return self._reduce(text, 0, len(text))

    def _reduce(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.bpe.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._reduce(text, lo, mid), self._reduce(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[lo:hi] from those of its two parts: only a window around mid is encoded again."""
        window = FIRST_WINDOW
        while True:
            a, b = self._cut_before(text, lo, max(lo, mid - window), mid), self._cut_after(text, mid, min(hi, mid + window), hi)
            if a is not None and b is not None:
                keep = self._upto(left, len(text[a:mid].encode()), from_end=True)
                skip = self._upto(right, len(text[mid:b].encode()), from_end=False)
                if keep is not None and skip is not None:  # both cuts are token borders, as the proof says
                    return left[:keep] + self.bpe.encode_ordinary(text[a:b]) + right[skip:]
            if mid - window <= lo and mid + window >= hi:
                return self.bpe.encode_ordinary(text[lo:hi])
            window *= 2

    @staticmethod
    def _safe(text: str, p: int) -> bool:
        return text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace()

    def _cut_before(self, text: str, lo: int, least: int, mid: int) -> int | None:
        for p in range(mid - 2, max(least, lo + 1) - 1, -1):
            if self._safe(text, p):
                return p
        return lo if least == lo else None

    def _cut_after(self, text: str, mid: int, most: int, hi: int) -> int | None:
        for p in range(mid + 1, min(most, hi - 1)):
            if self._safe(text, p):
                return p
        return hi if most == hi else None

    def _upto(self, ids: list[int], size: int, from_end: bool) -> int | None:
        """The index in ids that leaves `size` bytes at one end, if a token border lies there."""
        at, step = (len(ids), -1) if from_end else (0, 1)
        while size > 0:
            size -= self.length[ids[at - 1 if from_end else at]]
            at += step
        return at if size == 0 else None

    def decode(self, ids: list[int]) -> bytes:
        return self._concat(ids, 0, len(ids))

    def _concat(self, ids: list[int], lo: int, hi: int) -> bytes:
        if hi - lo <= 4096:
            return b"".join(map(self.token.__getitem__, ids[lo:hi]))
        mid = (lo + hi) // 2
        return self._concat(ids, lo, mid) + self._concat(ids, mid, hi)


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> Codec:
    """One codec for each rank file in a worker process."""
    return Codec(ranks_path, pattern, leaf_chars)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def run(batches):
        coder = codec(ranks_path, pattern, leaf_chars)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [coder.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(text_only(docs), run, "doc_id long, ids array<int>")


def bpe_decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) from (doc_id, ids); a null list decodes to nothing."""

    def run(batches):
        coder = codec(ranks_path, pattern)
        for b in batches:
            data = [coder.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return map_arrow(tokens.select("doc_id", "ids"), run, "doc_id long, data binary")


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, with_ids: bool = False) -> DataFrame:
    """Encodes, decodes and digests in one pass over the texts: no shuffle, a few documents in memory at a time.

    With with_ids the ids come along as `ids array<int>`, and an encoding that doesn't decode to its text is an error."""

    def run(batches):
        coder = codec(ranks_path, pattern, leaf_chars)
        decimal = coder.decimal.__getitem__
        for whole in batches:
            for b in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                rows, streams = [], []
                for text in b.column("text"):
                    text = text.as_py() or ""
                    ids = coder.encode(text)
                    back = coder.decode(ids)
                    if with_ids:
                        if back != text.encode():
                            raise ValueError("the ids don't decode to their text")
                        streams.append(ids)
                    rows.append((len(ids), hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
                n, ids_sha, text_sha = zip(*rows, strict=True) if rows else ((), (), ())
                cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols, names = [*cols, pa.array(streams, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(text_only(docs), run, SCHEMA + ", ids array<int>" * with_ids)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
