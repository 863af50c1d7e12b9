"""Substring dedup by De Bruijn compaction over windows of words.

A window of SPAN words is an edge between two nodes, its first and its last SPAN-1 words; the two nodes' 64-bit ids are
the edge's id. An edge seen at several source coordinates (document, first word) is repeated, and all its occurrences
but the earliest mark their words for removal. Only edges that can repeat are built:
1. Documents with equal word sequences are one class, judged at its least doc_id; all others of a class of SPAN words
   or more go whole.
2. Each window has an anchor, the least of its SPAN-K+1 K-word ids. Equal windows have equal anchors, so a window can only
   repeat if its anchor stands in several classes, which an aggregation over (anchor, class) finds, or if its document
   holds a K-word sequence twice. About one word in six is an anchor.
3. Those classes' texts give the edges at shared anchors, a row an occurrence; an aggregation by edge keeps the repeated
   ones, with their earliest coordinate.
4. Compaction: a node with one edge in and one out doesn't branch. Its two edges, found by joining the edges at their
   nodes, are links of one path if their earliest coordinates follow one another in one document. A path is therefore a
   stretch of its source document, from its head on, and has no cycles; one window pass over each source numbers its heads.
5. Occurrences join the paths and compact in turn: those that follow one another in a document and on a path are one
   span (document, start, words, source document, source start), verified by its source coordinates: each of its windows
   has the source window's two nodes. Spans other than the source itself join the documents, whose other words stay.
All meetings are Spark aggregations and joins that can spill; hot anchors, edges and classes are broadcast (join_hot).

Ids are 64-bit hashes: classes and edges go by two, nodes and anchors by one. Windows are judged on the input.

Cases: a null or empty text has no words; with fewer than SPAN words nothing is removed; rows of one doc_id with equal
words are one document, each row given the same result; rows of one doc_id with different words are documents in the
order of a hash of their words; a null doc_id is never compared and keeps all its words; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Words, drop, join_hot, map_arrow, sequence_hash, signed, table, text_chunks, text_only

SPAN, K = 20, 10
#: Coordinates count words from the document's rank among those of its doc_id times this.
RANKED = 1 << 32
#: Occurrences in an Arrow batch.
SLICE = 250_000


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's window anchor (least K-gram of the SPAN words from it on), and the K-grams."""
    grams, _ = words.grams(K)
    low = grams.copy()  # windows of 1, 2, 4, 8, then 11 grams by doubling
    for step in (1, 2, 4):
        low[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
    width = SPAN - K + 1
    n = len(low) - (width - 8)
    if n > 0:
        low[:n] = np.minimum(low[:n], low[width - 8 :])
    return low, grams


def _documents(column):
    """(row, words, anchors, K-grams, first word, end) of every text."""
    for at, end, data, offsets in text_chunks(column):
        words = Words(data, offsets, lower=False)
        low, grams = anchors(words)
        for i in range(end - at):
            yield at + i, words, low, grams, int(words.first[i]), int(words.first[i + 1])


def _twice(grams: np.ndarray) -> np.ndarray:
    """The ids that stand at several places."""
    every = np.sort(grams)
    return every[1:][every[1:] == every[:-1]]


def _survey(batches):
    """Each document's class, whether it holds a K-word sequence twice, and (once a class and batch) its anchors."""
    for b in batches:
        rows, keys, seen = [], [], set()
        for _, words, low, grams, lo, hi in _documents(b.column("text")):
            n, mine, own = hi - lo, np.zeros(0, dtype=np.uint64), False
            h = (sequence_hash(words.hash[lo:hi]), sequence_hash(words.hash[lo:hi], 1)) if n >= SPAN else (0, 0)
            if n >= SPAN and h not in seen:
                seen.add(h)
                mine, own = np.unique(low[lo : hi - SPAN + 1]), len(_twice(grams[lo : hi - K + 1])) > 0
            rows.append((n, *h, own))
            keys.append(mine)
        n, h1, h2, own = zip(*rows, strict=True) if rows else ((),) * 4
        offsets = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
        found = pa.ListArray.from_arrays(offsets, pa.array(signed(np.concatenate([*keys, np.zeros(0, dtype=np.uint64)]))))
        ids = [pa.array(signed(np.array(h, dtype=np.uint64))) for h in (h1, h2)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *ids, pa.array(own, pa.bool_()), found], names=["doc_id", "n", "h1", "h2", "own", "anchors"])


def nodes(words: np.ndarray) -> np.ndarray:
    """Ids of the (SPAN-1)-word sequences of one document."""
    one = Words.__new__(Words)
    one.hash, one.first = words, np.array([0, len(words)])
    return one.grams(SPAN - 1)[0][: len(words) - SPAN + 2]


def _edges(batches):
    """Texts with their classes' shared anchors -> occurrences (u, v, doc, at) of the windows that may repeat."""
    for b in batches:
        ids, ranks, h1, shared = (b.column(c).to_pylist() for c in ("doc_id", "rank", "h1", "anchors"))
        for i, words, low, grams, lo, hi in _documents(b.column("text")):
            if hi - lo < SPAN or np.uint64(sequence_hash(words.hash[lo:hi])) != np.int64(h1[i]).view(np.uint64):
                continue
            mine = low[lo : hi - SPAN + 1]
            wanted = np.union1d(np.array(shared[i], dtype=np.int64).view(np.uint64), _twice(grams[lo : hi - K + 1]))
            if not len(wanted):
                continue
            at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine)
            node = signed(nodes(words.hash[lo:hi]))
            for k in range(0, len(at), SLICE):
                part = at[k : k + SLICE]
                yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(node[part + 1]), pa.array(np.full(len(part), ids[i])), pa.array(part + ranks[i] * RANKED)], names=["u", "v", "doc", "at"])


def compacted(edges: DataFrame) -> DataFrame:
    """Repeated edges (u, v, n, s, p: earliest coordinate) with the head of their path: the edge (s, p) is p - head steps
    along the nonbranching path that begins at (s, head)."""
    only = lambda node, to: edges.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("c"), F.max("s").alias(f"s{to}"), F.max("p").alias(f"p{to}")).where("c = 1").drop("c")
    links = only("v", "in").join(only("u", "out"), "node").where("sin = sout AND pin + 1 = pout")
    nothing = F.lit(None).cast("long")
    marks = edges.select("s", "p", "u", "v", "n", F.lit(0).alias("linked")).unionByName(links.select(F.col("sout").alias("s"), F.col("pout").alias("p"), nothing.alias("u"), nothing.alias("v"), nothing.alias("n"), F.lit(1).alias("linked")))
    placed = marks.repartition("s").groupBy("s", "p").agg(*[F.max(c).alias(c) for c in ("u", "v", "n", "linked")])
    along = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("head", F.max(F.when(F.col("linked") == 0, F.col("p"))).over(along)).drop("linked")


def _spans(places: DataFrame) -> DataFrame:
    """Occurrences (doc, at, s, p, head) -> spans: those that follow one another in a document and on a path."""
    along = Window.partitionBy("doc").orderBy("at")
    before = {c: F.lag(c).over(along) for c in ("at", "s", "p", "head")}
    step = F.col("at") - before["at"]
    follows = (step <= 1) & (before["s"] == F.col("s")) & (before["head"] == F.col("head")) & (F.col("p") - before["p"] == step)
    begins = places.withColumn("new", F.when(follows, 0).otherwise(1))
    numbered = begins.withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "span").agg(F.min("at").alias("start"), F.max("at").alias("last"), F.min("s").alias("source"), F.min("p").alias("source_start"), F.min("head").alias("head")).drop("span")


class Repeats:
    """Everything that is repeated in docs: classes, the copies of each, and the spans."""

    def __init__(self, docs: DataFrame):
        texts = text_only(docs)
        survey = table(map_arrow(texts, _survey, "doc_id long, n long, h1 long, h2 long, own boolean, anchors array<long>"))
        self.members = table(survey.where(f"n >= {SPAN} AND doc_id IS NOT NULL").select("doc_id", "h1", "h2"))
        least = survey.where(f"n >= {SPAN} AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("own").alias("own"))
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("h1", "h2")) - 1
        self.classes = table(least.withColumn("rank", rank.cast("long")))
        pairs = survey.where("doc_id IS NOT NULL").select("h1", F.explode("anchors").alias("anchor"))
        shared = table(pairs.groupBy("anchor").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("anchor", "n"))
        of_class = join_hot(pairs, shared, "anchor", "n").groupBy("h1").agg(F.collect_set("anchor").alias("anchors"))
        known = self.classes.join(of_class, "h1", "left").where("own OR anchors IS NOT NULL")
        active = table(known.select("doc_id", "rank", "h1", F.coalesce("anchors", F.expr("cast(array() AS array<long>)")).alias("anchors")))
        drop(survey, shared)
        occurrences = table(map_arrow(texts.join(active.hint("merge"), "doc_id").select("doc_id", "rank", "h1", "text", "anchors"), _edges, "u long, v long, doc long, at long"))
        drop(active)
        first = F.min(F.struct("doc", "at")).alias("f")
        edges = table(occurrences.groupBy("u", "v").agg(first, F.count("*").alias("n")).where("n > 1").select("u", "v", "n", F.col("f.doc").alias("s"), F.col("f.at").alias("p")))
        paths = table(compacted(edges))
        places = join_hot(occurrences, paths, ["u", "v"], "n").where("NOT (doc = s AND at = p)").select("doc", "at", "s", "p", "head")
        self.spans = table(_spans(places))
        drop(occurrences, edges, paths)

    def plan(self) -> DataFrame:
        """(doc_id, several, plan): what goes from the texts of each document that loses words, by class; a class without
        spans goes whole."""
        copied = table(self.classes.where("copies > 1").select("h1", "h2", F.col("doc_id").alias("least"), "copies"))
        whole = join_hot(self.members, copied, ["h1", "h2"], "copies").where("doc_id > least").select("doc_id", "h1").distinct()
        pairs = F.sort_array(F.collect_list(F.struct((F.col("start") % RANKED).cast("int").alias("a"), (F.col("last") % RANKED).cast("int").alias("b")))).alias("spans")
        cut = self.spans.groupBy(F.col("doc").alias("doc_id"), F.expr(f"start div {RANKED}").alias("rank")).agg(pairs).join(self.classes.select("doc_id", "rank", "h1"), ["doc_id", "rank"])
        entries = cut.select("doc_id", "h1", "spans").unionByName(whole.withColumn("spans", F.lit(None).cast("array<struct<a:int,b:int>>")))
        several = self.members.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("doc_id", F.lit(True).alias("several"))
        return entries.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "spans")).alias("plan")).join(several, "doc_id", "left")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, source_doc, source_start, path): maximal stretches of words that stand earlier too, without
    whole copies of SPAN words or more (see Repeats.plan); start counts words, path is its head's place in the source."""
    found = Repeats(docs).spans
    return found.select(F.col("doc").alias("doc_id"), (F.col("start") % RANKED).alias("start"), (F.col("last") - F.col("start") + SPAN).alias("n_words"), F.col("source").alias("source_doc"), (F.col("source_start") % RANKED).alias("source_start"), (F.col("head") % RANKED).alias("path"))


def _entry(text: pa.Scalar, several: bool | None, plan: list) -> dict | None:
    """What goes from this text: of a doc_id with several texts the entry of its words."""
    if not several:
        return plan[0]
    _, words, _, _, lo, hi = next(_documents(pa.array([text.as_py()])))
    own = int(signed(np.array([sequence_hash(words.hash[lo:hi])], dtype=np.uint64))[0]) if hi - lo >= SPAN else None
    return next((e for e in plan if e["h1"] == own), None)


def _kept(with_text: bool):
    def run(batches):
        for b in batches:
            rows = []
            for text, several, plan in zip(b.column("text"), b.column("several").to_pylist(), b.column("plan").to_pylist(), strict=True):
                words = text.as_py().encode().split()  # bytes.split cuts at exactly the six separators
                n, removed = len(words), 0
                entry = _entry(text, several, plan) if plan and n >= SPAN else None
                if entry and entry["spans"] is None:
                    words, removed = [], n
                elif entry:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    spans = np.array([(s["a"], s["b"]) for s in entry["spans"]])
                    np.add.at(gone, spans[:, 0], 1)
                    np.add.at(gone, spans[:, 1] + SPAN, -1)
                    keep = np.cumsum(gone[:n]) == 0
                    removed = n - int(keep.sum())
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                kept = b" ".join(words)
                rows.append((n, removed, kept.decode() if with_text else hashlib.sha256(kept).hexdigest()))
            n, removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, or their SHA-256."""
    plan = table(Repeats(docs).plan())
    joined = text_only(docs).join(plan.hint("merge"), "doc_id", "left").select("doc_id", "text", "several", "plan")
    return map_arrow(joined, _kept(with_text), "doc_id long, n_words long, n_removed long, kept string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).withColumnRenamed("kept", "kept_sha256")
