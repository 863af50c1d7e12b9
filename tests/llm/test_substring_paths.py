"""Branching and cyclic repeats, equal doc_ids, and the spans themselves."""

import random

from gridloom.llm import op6_substrings as op6
from tests.llm import brute

DOCS = "doc_id long, text string"


def frame(spark, docs, parts=3):
    return spark.createDataFrame(docs, DOCS).repartition(parts)


def branching(seed=8):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(n))
    stem, left, right = text(40), text(30), text(30)
    docs = [f"{text(7)} {stem} {left} {text(5)}", f"{text(9)} {stem} {right}", f"{left} {stem}", f"{stem} {left}", f"{text(3)} {right} {text(4)} {stem} {right}"]
    docs += ["a b " * 40, "b a " * 35 + "c", "a " * 70, "a b c " * 25 + stem, " ".join(stem.split()[5:33]), f"{left} {left} {right} {right}"]
    half = stem.split()
    half[20] = "other"
    docs += [" ".join(half), " ".join(half[:30]), f"{text(25)} x", stem]
    return list(enumerate(docs))


def test_op6_branches_and_cycles(spark):
    docs = branching()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in op6.dedup_substrings(frame(spark, docs), with_text=False).collect()}
    assert got == brute.substrings(docs)


def test_op6_spans_stand_at_their_source(spark):
    docs = branching()
    words = {i: brute.words(t) for i, t in docs}
    spans = op6.repeated_spans(frame(spark, docs)).collect()
    covered = {i: set() for i in words}
    for r in spans:
        assert r.n_words >= op6.SPAN and (r.source_doc, r.source_start) < (r.doc_id, r.start) and r.path <= r.source_start
        assert words[r.doc_id][r.start : r.start + r.n_words] == words[r.source_doc][r.source_start : r.source_start + r.n_words]
        covered[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    assert {i: len(c) for i, c in covered.items() if c} == {i: v[1] for i, v in brute.substrings(docs).items() if v[1]}
    straight = [r for r in spans if not 5 <= r.doc_id <= 8]  # cycles leave their path at every turn
    assert 8 <= len(straight) <= 30


def test_op6_paths_do_not_branch(spark):
    edges = [(1, 2, 7, 0), (2, 3, 7, 1), (3, 4, 7, 2), (3, 5, 8, 9), (4, 6, 7, 3), (9, 8, 7, 4)]
    df = spark.createDataFrame([(u, v, 2, s, p) for u, v, s, p in edges], "u long, v long, n long, s long, p long")
    assert {(r.u, r.v): (r.s, r.head) for r in op6.compacted(df).collect()} == {(1, 2): (7, 0), (2, 3): (7, 0), (3, 4): (7, 2), (3, 5): (8, 9), (4, 6): (7, 2), (9, 8): (7, 4)}


def test_op6_one_doc_id_with_several_texts(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(str(rng.randrange(1000)) for _ in range(n))
    a, b, c = text(30), text(40), text(25)
    docs = [(1, a), (1, f"{b} {a}"), (2, f"{c} {b}"), (2, a), (2, a), (2, None), (3, c), (None, a)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in op6.dedup_substrings(frame(spark, docs)).collect())
    longer = next(x for x in got if x[0] == 1 and x[1] == 70)
    shorter = next(x for x in got if x[0] == 1 and x[1] == 30)
    assert {longer[2], shorter[2]} in ({30, 0}, {0, 30})  # the one whose hash is greater repeats the other
    assert [x for x in got if x[0] != 1] == [(0, 30, 0), (2, 0, 0), (2, 30, 30), (2, 30, 30), (2, 65, 40), (3, 25, 25)]
