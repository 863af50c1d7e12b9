"""Co-training against a plain one, repeated ids, parts that don't meet."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import op9_quality as op9

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=900, seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(word() for _ in range(70)) if good else rng.choice([(word() + " ") * 60, " ".join(word().upper() + "!!" for _ in range(60))])
        docs.append((i, text, "en", f"s{rng.randrange(4) if good else rng.randrange(3, 8)}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels


def plain_fit(x, y):
    """Ridge logistic regression by plain gradient descent on standardised features."""
    mean, scale = x.mean(0), np.where(x.std(0) < 1e-9, 1, x.std(0))
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(6000):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= 2.0 / (len(x) + 4) * (z.T @ (p - y) + penalty * w)
    return lambda a: np.clip(np.column_stack([(a - mean) / scale, np.ones(len(a))]) @ w, -30, 30)


def test_op9_models_equal_plain_ones():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = (x @ [1, -2, 0.5, 0, 0] + rng.normal(size=300) > 0).astype(float)
    assert np.abs(op9.Logistic().fit(x, y).logit(x) - plain_fit(x, y)(x)).max() < 0.05


def test_op9_co_training_equals_a_plain_one():
    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.6).astype(float)
    text, meta = (rng.normal(size=(600, 3)) + 2.5 * y[:, None] for _ in range(2))
    own, pool = slice(0, 200), slice(200, 600)
    model = op9.CoTrained(text[own], meta[own], y[own], text[pool], meta[pool])
    place, turn = np.zeros(200, dtype=int), [0, 0]
    for i, c in enumerate(y[own].astype(int)):
        place[i], turn[c] = turn[c] % 10, turn[c] + 1
    views = [(op9._expand(text[own]), op9._expand(text[pool])), (meta[own], meta[pool])]
    train, calibrate, combine = place <= 5, (place == 6) | (place == 7), place == 8
    extra, taught = [(np.zeros(0, dtype=int), np.zeros(0))] * 2, []
    for r in range(op9.ROUNDS + 1):
        fits = [plain_fit(np.concatenate([a[train], b[extra[v][0]]]), np.concatenate([y[own][train], extra[v][1]])) for v, (a, b) in enumerate(views)]
        plates = [plain_fit(fits[v](a[calibrate])[:, None], y[own][calibrate]) for v, (a, _) in enumerate(views)]
        if r < op9.ROUNDS:
            p = [1 / (1 + np.exp(-plates[v](fits[v](b)[:, None]))) for v, (_, b) in enumerate(views)]
            sure = [np.flatnonzero((q >= op9.CONFIDENCE) | (q <= 1 - op9.CONFIDENCE)) for q in p]
            extra = [(sure[1 - v], (p[1 - v][sure[1 - v]] >= 0.5).astype(float)) for v in (0, 1)]
            taught.append([len(e[0]) for e in extra])
    logits = lambda k: np.column_stack([plates[v](fits[v](views[v][0][k])[:, None]) for v in (0, 1)])
    both = plain_fit(logits(combine), y[own][combine])
    score = model.scores(text[own], meta[own])[2]
    assert taught[0][0] > 20 and np.abs(np.array(taught) - model.taught).max() <= 12
    assert np.mean((both(logits(slice(None))) >= 0) == (score >= 0.5)) >= 0.99


def test_op9_test_part_is_seen_by_nothing():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 4)), (rng.random(400) < 0.5).astype(float)
    model = op9.CoTrained(x, rng.normal(size=(400, 3)), y, x[:0], x[:0, :3])
    assert abs(model.held_out_accuracy - 0.5) < 0.2  # labels of no sense can't be told by the test part
    used = [set(p) for p in (op9.TRAIN, op9.CALIBRATE, op9.COMBINE, op9.TEST)]
    assert sum(map(len, used)) == 10 and set().union(*used) == set(range(10))


def test_op9_views_share_no_feature():
    a = op9.text_features(pa.array(["some words of a text, repeated.\n" * 3, "some words of a text, repeated.\n" * 300]))
    b = op9.meta_features(["s"] * 2, ["en"] * 2, [96, 9600])
    assert a.shape[1] == op9.N_TEXT and np.abs(a[0, :13] - a[1, :13]).max() < 0.4 and np.abs(b[0] - b[1]).max() > 0.2


def test_op9_repeated_ids_are_sampled_once(spark):
    docs, labels = corpus()
    many = docs + [docs[0]] * 300 + [(0, "another text", "en", None, None)] * 5
    table, own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spark.createDataFrame(many, SCHEMA).repartition(4)
    sample = op9._sample(own, table, op9.MAX_LABELLED, op9.MAX_POOL)
    assert sample.count() == sample.select("doc_id").distinct().count() == len(docs)
    model = op9.fit(own, table)
    assert model.held_out_accuracy >= 0.95
    got = op9.score(own, model)
    assert got.count() == len(many) and got.where("doc_id = 0").count() == 306
    truth = {i: y for i, y, _ in labels}
    keep = {r.doc_id: r.keep for r in got.where(F.col("doc_id") > 0).collect()}
    assert np.mean([keep[i] == bool(y) for i, y in truth.items() if i]) >= 0.95
    assert op9.fit(own, table.where("quality = 1 OR doc_id < 20")) is None
