"""The R-tree at every height, tiles of several blocks, buckets one at a time, forests that wait."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import op4_jaccard as op4
from tests.llm import brute


def sets(rng, n):
    out = [np.unique(rng.integers(0, 2**63, m, dtype=np.uint64)) for m in rng.integers(1, 400, n)]
    return out + [np.unique(np.append(s[: max(1, int(len(s) * 0.93))], rng.integers(0, 2**63, 2, dtype=np.uint64))) for s in out]


@pytest.mark.parametrize("leaf, fan", [(1, 2), (2, 2), (3, 4), (32, 8)])
def test_op4_tree_of_any_height(monkeypatch, leaf, fan):
    monkeypatch.setattr(op4, "LEAF", leaf)
    monkeypatch.setattr(op4, "FAN", fan)
    rng = np.random.default_rng(leaf)
    all_sets = sets(rng, 70)
    points, n = [op4.unpacked(op4.point(s)) for s in all_sets], np.array([len(s) for s in all_sets])
    comp = rng.integers(0, 40, len(n))
    found = [tuple(sorted(p)) for x, y, _ in op4.tree_pairs(points, n, comp) for p in zip(x.tolist(), y.tolist(), strict=True)]
    want = set()
    for a in range(len(n)):
        for b in range(a):
            g = min(len(points[a]), len(points[b]))
            if comp[a] != comp[b] and 7 * np.minimum(op4.fold(points[a], g), op4.fold(points[b], g)).sum() >= 3 * (n[a] + n[b]):
                want.add((b, a))
    assert len(found) == len(set(found)) and set(found) == want


def test_op4_tree_prunes_boxes():
    small = [op4.unpacked(op4.point(s)) for s in sets(np.random.default_rng(1), 40)]
    sizes = np.array([int(p.sum()) for p in small])
    tree = op4.Tree(np.arange(len(small)), np.zeros((len(small), 64)), np.sort(sizes), np.arange(len(small)))
    assert len(tree.levels[-1][0]) == 1 and len(list(op4._leaf_pairs(tree, tree))) < len(tree.levels[0][0]) * (len(tree.levels[0][0]) + 1) / 2


def test_op4_leaves_of_a_slice_at_once(monkeypatch):
    rng = np.random.default_rng(11)
    all_sets = [s for _ in range(40) for s in sets(rng, int(rng.integers(1, op4.LEAF // 2)))]
    all_sets = [all_sets[k] for k in rng.permutation(len(all_sets))]
    n, blobs = np.array([len(s) for s in all_sets]), [op4.point(s) for s in all_sets]
    comp, bucket = rng.integers(0, 400, len(n)), np.sort(rng.integers(0, len(n) // 8, len(n)))
    assert np.bincount(bucket).max() <= op4.LEAF
    # copies of some sets, in the same bucket, so that every kind of pair occurs
    for k in np.flatnonzero(bucket[1:] == bucket[:-1])[::3]:
        n[k + 1], blobs[k + 1] = n[k], blobs[k]
    a, b, score = op4.leaf_links(bucket, n, comp, blobs)
    got = {(min(x, y), max(x, y)): s for x, y, s in zip(a.tolist(), b.tolist(), score.tolist(), strict=True)}
    want = {}
    for k in np.unique(bucket):
        own = np.flatnonzero(bucket == k)
        for x, y, s in op4.tree_pairs([op4.unpacked(blobs[r]) for r in own], n[own], comp[own]):
            want |= {(int(min(own[i], own[j])), int(max(own[i], own[j]))): v for i, j, v in zip(x, y, s, strict=True)}
    assert len(a) == len(got) and got == pytest.approx(want) and len(want) > 20
    empty = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in op4.leaf_links(empty, empty, empty, [])] == [0, 0, 0]
    # leaves and taller trees give the same components
    t = pa.table({"key": bucket, "id": np.arange(len(n)), "n": n, "comp": comp, "blob": blobs})
    joined = lambda: brute.components(range(len(n)), [(a, b) for x in op4._chains(t.to_batches(50)) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)])
    whole = joined()
    monkeypatch.setattr(op4, "LEAF", 4)
    assert joined() == whole


def test_op4_tiles_of_several_blocks(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    docs = []
    for i in range(120):  # many texts of one cluster, some of which link
        mine = list(words[:100])
        for at in rng.sample(range(100), rng.choice([1, 3, 4, 5, 6, 8])):
            mine[at] = rng.choice(words)
        docs.append((i, " ".join(mine)))
    want = brute.jaccard(docs)
    assert 3 < len({c for _, c in want.values()}) < 115
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for block in (op4.BLOCK, 8, 30):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in op4.jaccard_components(df, block).collect()} == want


def test_op4_buckets_come_one_at_a_time():
    rng = np.random.default_rng(3)
    pairs = np.zeros(500, dtype=op4.PAIR)
    pairs["key"], pairs["id"] = rng.integers(0, 150, 500), rng.integers(0, 30, 500)
    rows = [(1, int(k), None, None, pairs[(pairs["key"] % 7 == k)][lo::3].tobytes()) for k in range(7) for lo in range(3)]
    batches = [op4._batch(*map(list, zip(*rows[at : at + 4], strict=True))) for at in range(0, len(rows), 4)]
    got = {(k, i) for b in op4._shared(batches) for k, i in zip(b.column("key").to_pylist(), b.column("id").to_pylist(), strict=True)}
    ids = {}
    for k, i in pairs.tolist():
        ids.setdefault(k, set()).add(i)
    assert got == {(k, i) for k, v in ids.items() if len(v) > 1 for i in v}


def test_op4_waiting_links_keep_their_forest(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    near = [np.unique(np.append(base[rng.random(100) < 0.9], rng.integers(0, 2**63, 3, dtype=np.uint64))) for _ in range(90)]
    t = pa.table({"key": [1] * 90, "id": list(range(90)), "n": [len(s) for s in near], "comp": list(range(90)), "blob": [op4.point(s) for s in near]})
    joined = lambda: brute.components(range(90), [(a, b) for x in op4._chains(t.to_batches()) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)])
    whole = joined()
    monkeypatch.setattr(op4, "WAITING", 5)
    assert joined() == whole and len(set(whole.values())) < 90
