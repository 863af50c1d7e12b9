"""The pipeline against plain versions of its stages, each on its own input."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline
from gridloom.llm import op2_bpe, op9_quality
from gridloom.llm.common import table
from tests.llm import brute

BENCH = " ".join(f"exam{k}" for k in range(20))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, docs = text(80), []
    for i in range(240):
        if i % 6 == 0:
            t = (word() + " ") * 70
        elif i % 6 == 1:
            t = base if i % 12 == 1 else base.rsplit(" ", 2)[0] + " " + text(2)
        elif i % 6 == 2:
            t = f"{text(30)}\nread more about cookies\n{text(30)}\n{text(10)}"
        elif i == 3:
            t = f"{text(20)} {BENCH} {text(20)}"
        else:
            t = text(60)
        docs.append((i, t, "en", f"src{i // 6 % 9}", len(t)))
    docs += [(500, "", "en", None, 0), (501, None, None, "src1", None)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 240, 1) if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, BENCH), (2, "too short")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def read(df):
    return sorted((r.doc_id, r.text, r.source) for r in df.collect())


def test_every_stage_on_its_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        results.append(table(stage(spark, docs, sf_dir)))
        docs = results[-1]
    quality, lines, near, clean, tokens = results
    assert all(r.columns == columns for r in results[:-1])

    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keep = {r.doc_id for r in op9_quality.score(whole, op9_quality.fit(whole, labels)).where("keep").collect()}
    assert read(quality) == [d for d in read(whole) if d[0] in keep]
    assert not keep & set(range(0, 240, 6)) and keep >= {i for i in range(240) if i % 6}

    plain = brute.lines_kept(read(quality), 5)
    assert {i: t or "" for i, t, _ in read(lines)} == {i: v[2] for i, v in plain.items()} and sum(v[1] for v in plain.values()) >= 30
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.text is not None)

    comp = brute.jaccard([(i, t) for i, t, _ in read(lines)])
    assert read(near) == [d for d in read(lines) if comp[d[0]][1] == d[0]] and near.count() < lines.count() - 30

    assert read(clean) == [d for d in read(near) if BENCH not in (d[1] or "")] and clean.count() == near.count() - 1

    coder = op2_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: (r.ids, r.n_tokens, r.decoded_sha256) for r in tokens.collect()}
    assert set(got) == {i for i, _, _ in read(clean)}
    for i, t, _ in read(clean):
        ids = coder.bpe.encode_ordinary(t or "")
        assert got[i] == (ids, len(ids), hashlib.sha256((t or "").encode()).hexdigest())

    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.ids_sha256) for r in tokens.collect())
