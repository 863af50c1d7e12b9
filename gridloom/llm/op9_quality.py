"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then score all documents.

Text view: shape statistics of the whole text (repetition of words and word triples, longest run of one word, shares
of upper case, digits, signs and non-ASCII bytes, word and line lengths), none of which is its length. Metadata view:
site, language and recorded length. So no feature is in both. Both are logistic models. Fitting uses a bounded sample:
at most `max_labelled` labelled and `max_pool` unlabelled documents, taken in the order of a hash of doc_id. Of each
class's labelled documents, in that order, 6 of 10 train, 2 calibrate, 1 combines and 1 tests. In each of `rounds`
rounds each view labels the pool documents it is most sure of (calibrated probability beyond `confidence`) for the
other view. At the end each view is calibrated on the calibration part (Platt), a third logistic model over both
calibrated logits is fitted on the combination part, and held_out_accuracy is the combined accuracy on the test part,
which nothing else has seen. Every document is scored, in one pass without a shuffle; a document is kept if its
combined probability of good quality is at least `threshold`.

Cases: a null or empty text has all-zero text statistics; null metadata falls in a bucket of its own; labels that
are null or of unknown documents are ignored, of repeated ones the greatest counts; of rows that share a doc_id the one
with the least hash of its text is in the sample; with fewer than LEAST_LABELS labels of either class nothing is learnt
and every document is kept with score 1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Words, map_arrow, text_chunks

MAX_LABELLED, MAX_POOL = 10_000, 10_000
ROUNDS, CONFIDENCE, THRESHOLD = 3, 0.97, 0.5
LEAST_LABELS = 10
#: What the k-th labelled document of a class is for, by k % 10.
TRAIN, CALIBRATE, COMBINE, TEST = (0, 1, 2, 3, 4, 5), (6, 7), (8,), (9,)
N_TEXT, SITE_BUCKETS, LANG_BUCKETS = 16, 64, 16
N_META = SITE_BUCKETS + LANG_BUCKETS + 3

_CLASS = np.full(256, 3)  # upper, lower, digit, sign, white, high
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def text_features(column: pa.Array) -> np.ndarray:
    """[texts, N_TEXT] statistics of whole texts."""
    out = np.zeros((len(column), N_TEXT))
    for at, end, data, offsets in text_chunks(column):
        n = end - at
        size = np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        shares = np.bincount(doc * 6 + _CLASS[data], minlength=6 * n).reshape(n, 6) / np.maximum(size, 1)[:, None]
        words = Words(data, offsets, lower=True)
        count = np.diff(words.first)
        word_doc = np.repeat(np.arange(n), count)
        safe = np.maximum(count, 1)
        length = np.bincount(word_doc, words.stop - words.start, n) / safe
        same = np.zeros(len(words.hash), dtype=bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (word_doc[1:] == word_doc[:-1])
        triple, inside = words.grams(3)
        f = out[at:end]
        f[:, :6] = shares
        f[:, 6] = np.bincount(word_doc, (words.stop - words.start) > 20, n) / safe
        f[:, 7] = length
        f[:, 8] = np.bincount(word_doc, same, n) / safe
        first = data[words.start] if len(words.start) else np.zeros(0, dtype=np.uint8)
        last = data[words.stop - 1] if len(words.start) else np.zeros(0, dtype=np.uint8)
        f[:, 9] = np.bincount(word_doc, _CLASS[first] == 0, n) / safe
        f[:, 10] = np.bincount(word_doc, _CLASS[last] == 3, n) / safe
        f[:, 11] = np.bincount(word_doc, (words.stop - words.start) <= 2, n) / safe
        f[:, 12] = np.log1p(size / (1 + np.bincount(doc, data == 10, n)))
        for i in range(n):
            lo, hi = words.first[i], words.first[i + 1]
            if hi > lo:
                _, c = np.unique(words.hash[lo:hi], return_counts=True)
                f[i, 13], f[i, 14] = len(c) / (hi - lo), c.max() / (hi - lo)
                t = triple[lo:hi][inside[lo:hi]]
                f[i, 15] = len(np.unique(t)) / len(t) if len(t) else 1.0
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """[rows, N_META]: hashed site and language, recorded length."""
    out = np.zeros((len(source), N_META))
    rows = np.arange(len(source))
    bucket = lambda values, n: np.array([0 if v is None else 1 + zlib.crc32(str(v).encode()) % (n - 1) for v in values], dtype=int)
    out[rows, bucket(source, SITE_BUCKETS)] = 1
    out[rows, SITE_BUCKETS + bucket(lang, LANG_BUCKETS)] = 1
    size = np.log1p(np.array([max(0, v or 0) for v in n_chars], dtype=float))
    out[:, -3:] = np.column_stack([size / 10, (size / 10) ** 2, [v is None for v in n_chars]])
    return out


class Logistic:
    """L2 logistic regression on standardised features, by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-9] = 1
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        self.w = np.zeros(z.shape[1])
        penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) @ self.w, -30, 30)


def _expand(x: np.ndarray) -> np.ndarray:
    """Text statistics with their squares and logarithms, so that both tails can count against a text."""
    return np.column_stack([x, x**2, np.log(np.abs(x) + 1e-3)])


def _p(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


def parts(y: np.ndarray) -> np.ndarray:
    """Each labelled document's number within its class, modulo 10."""
    out = np.zeros(len(y), dtype=int)
    for c in (0, 1):
        out[y == c] = np.arange((y == c).sum()) % 10
    return out


class CoTrained:
    """Two views, their calibrations and their combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, confidence: float = CONFIDENCE):
        text, pool_text = _expand(text), _expand(pool_text)
        train, calibrate, combine, test = (np.isin(parts(y), p) for p in (TRAIN, CALIBRATE, COMBINE, TEST))
        views = [[text, pool_text], [meta, pool_meta]]
        extra: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=int), np.zeros(0)) for _ in views]
        self.models, self.plates, self.taught = [None, None], [None, None], []
        for r in range(rounds + 1):
            for v, (own, pool) in enumerate(views):
                at, label = extra[v]
                self.models[v] = Logistic().fit(np.concatenate([own[train], pool[at]]), np.concatenate([y[train], label]))
                self.plates[v] = Logistic().fit(self.models[v].logit(own[calibrate])[:, None], y[calibrate])
            if r == rounds or not len(pool_text):
                break
            p = [_p(self.plates[v].logit(self.models[v].logit(pool)[:, None])) for v, (_, pool) in enumerate(views)]
            for v in (0, 1):  # what the other view is sure of
                at = np.flatnonzero((p[1 - v] >= confidence) | (p[1 - v] <= 1 - confidence))
                extra[v] = (at, (p[1 - v][at] >= 0.5).astype(float))
            self.taught.append([len(e[0]) for e in extra])
        self.both = Logistic().fit(self._logits(text[combine], meta[combine]), y[combine])
        self.held_out_accuracy = float(np.mean((self.both.logit(self._logits(text[test], meta[test])) >= 0) == y[test]))

    def _logits(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.column_stack([self.plates[v].logit(self.models[v].logit(x)[:, None]) for v, x in enumerate((text, meta))])

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = self._logits(_expand(text), meta)
        return _p(both[:, 0]), _p(both[:, 1]), _p(self.both.logit(both))


def _views(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def _first(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int, max_pool: int) -> DataFrame:
    """The views of the sampled documents, one row an id, with y where labelled."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    pool = _first(ids.join(known, "doc_id", "left_anti"), max_pool).select("doc_id", F.lit(None).cast("double").alias("y"))
    picked = _first(known.join(ids, "doc_id", "left_semi"), max_labelled).unionByName(pool)
    rows = _views(docs).join(F.broadcast(picked), "doc_id")  # at most max_labelled + max_pool ids
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "source", "lang", "n_chars")).alias("x")
    return rows.groupBy("doc_id", "y").agg(one).select("doc_id", "y", "x.text", "x.source", "x.lang", "x.n_chars")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL, **options) -> CoTrained | None:
    """Fits on the bounded sample; None if it holds too few labels of a class."""
    sample = _sample(docs, labels, max_labelled, max_pool)

    def run(batches):
        for b in batches:
            text = text_features(b.column("text"))
            meta = meta_features(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            rows = np.column_stack([text, meta])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = sorted(map_arrow(sample, run, "doc_id long, y double, x array<double>").collect(), key=lambda r: zlib.crc32(str(r.doc_id).encode()))
    x = np.array([r.x for r in rows]).reshape(len(rows), -1)
    y = np.array([np.nan if r.y is None else float(r.y > 0) for r in rows])
    has = ~np.isnan(y)
    if min((y == c).sum() for c in (0, 1)) < LEAST_LABELS:
        return None
    return CoTrained(x[has, :N_TEXT], x[has, N_TEXT:], y[has], x[~has, :N_TEXT], x[~has, N_TEXT:], **options)


def score(docs: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) of every document."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            if model is None:
                p = (np.ones(n),) * 3
            else:
                p = model.scores(text_features(b.column("text")), meta_features(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, p), pa.array(p[2] >= threshold)], names=["doc_id", "p_text", "p_meta", "score", "keep"])

    return map_arrow(_views(docs), run, "doc_id long, p_text double, p_meta double, score double, keep boolean")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that the classifier keeps; texts don't shuffle."""
    model = fit(docs, labels)
    if model is None:
        return docs
    schema = docs.schema

    def run(batches):
        for b in batches:
            views = [pa.compute.cast(b.column(c), k) for c, k in (("text", pa.string()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()))]
            p = model.scores(text_features(views[0]), meta_features(*(v.to_pylist() for v in views[1:])))[2]
            yield b.filter(pa.array(p >= threshold))

    return map_arrow(docs, run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
