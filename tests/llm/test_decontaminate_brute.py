"""op10 against all windows of all items over all documents, in any number of blocks; odd rows."""

import random

import pyarrow as pa

from gridloom.llm import op10_decontaminate as op10


def plain(text, item):
    """The best share of equal words in a window of the item laid over the text, 0 below the rule."""
    a, b = (text or "").lower().split(), item.lower().split()
    if len(b) < op10.MIN_WORDS:
        return 0.0
    w, best = min(op10.WINDOW, len(b)), 0.0
    for shift in range(-len(b), len(a)):
        equal = [0 <= k + shift < len(a) and a[k + shift] == x for k, x in enumerate(b)]
        best = max([best, *(sum(equal[k : k + w]) / w for k in range(len(b) - w + 1))])
    return best if best >= op10.MIN_SHARE else 0.0


def planted(seed=11):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(60))
    items = [(k, " ".join(word() for _ in range(k % 37 + 4))) for k in range(74)] + [(90, "too short here"), (91, " ".join(["same"] * 15)), (92, None)]
    docs = []
    for k, text in items[:74]:
        words = text.split()
        for share in (0.0, 0.15, 0.25, 0.4):
            for _ in range(2):
                mine = list(words)
                for at in rng.sample(range(len(mine)), round(share * len(mine))):
                    mine[at] = "other"
                docs.append(" ".join([*(word() for _ in range(rng.randrange(12))), *mine, *(word() for _ in range(rng.randrange(12)))]))
    docs += ["same " * 30, " ".join(word() for _ in range(200)), "", None, docs[0], docs[0]]
    return list(enumerate(docs)), items


def test_op10_against_all_windows(spark):
    docs, items = planted()
    want = {}
    for i, text in docs:
        shares = {k: s for k, t in items if t and (s := plain(text, t))}
        want[i] = (sorted(shares), max(shares.values(), default=0.0))
    assert 200 < sum(bool(v[0]) for v in want.values()) < len(docs) - 50
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 30):
        got = {r.doc_id: (r.item_ids, r.best_share) for r in op10.decontaminate(df, bench, block).collect()}
        assert got == want
        kept = {r.doc_id for r in op10.filter_contaminated(df, bench, block).collect()}
        assert kept == {i for i, v in want.items() if not v[0]}


def test_op10_repeated_and_null_rows(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text), (1, text), (1, "clean"), (None, text), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, text), (5, text), (6, text.upper())], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.contaminated, r.item_ids) for r in op10.decontaminate(df, bench).collect())
    assert got == [(0, False, []), (0, True, [5, 6]), (1, False, []), (1, True, [5, 6]), (1, True, [5, 6])]
    assert sorted((r.doc_id or 0, r.text) for r in op10.filter_contaminated(df, bench).collect() if r.doc_id) == [(1, "clean")]


def test_op10_hits_in_pieces(spark, monkeypatch):
    docs, items = planted(12)
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs[:80], "doc_id long, text string")
    whole = sorted((r.doc_id, r.item_ids) for r in op10.decontaminate(df, bench).collect())
    index = op10.SeedIndex([(k, t) for k, t in items if t])
    monkeypatch.setattr(op10, "SLICE", 7)
    assert [(i, sorted(x)) for (i, _), x in zip(docs[:80], index.leaks(pa.array([t for _, t in docs[:80]])), strict=True)] == whole
