import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import op1_embeddings, op2_bpe, op3_licenses, op4_jaccard, op5_token_store, op6_substrings, op7_lines, op8_pii, op9_quality, op10_decontaminate
from gridloom.llm.components import connected_components
from tests.llm import brute

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, docs, extra=True, parts=3):
    """Documents, with columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 7}", len(t or "")) for i, t in docs], DOCS).repartition(parts)
    if extra:
        for name in ("key", "id", "h1", "n", "blob", "kind", "base", "spans", "paths", "ids", "n_removed", "gone", "site", "pos"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def rows(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


@pytest.fixture(scope="module")
def docs():
    return brute.corpus()


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1064)] + [(5, 5), (1, 2), (2, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = brute.components({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_op1_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    vectors = [(i, (base[i % 6] + 0.27 * rng.normal(size=16)).tolist(), i % 3) for i in range(150)]
    vectors += [(200, vectors[0][1], 0), (201, vectors[0][1], 0), (202, vectors[0][1], 1)]
    odd = [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [None] + [1.0] * 15, 0), (304, vectors[0][1], None), (305, [float("inf")] + [1.0] * 15, 0), (306, [], 0), (307, [1.0, 2.0], 0)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("links", F.lit(2))
    e = np.array([np.float32(v[1]) for v in vectors], dtype=float)
    unit = e / np.linalg.norm(e, axis=1)[:, None]
    near = (unit @ unit.T >= op1_embeddings.THRESHOLD) & np.equal.outer([v[2] for v in vectors], [v[2] for v in vectors])
    np.fill_diagonal(near, False)
    ids = [v[0] for v in vectors]
    comp = brute.components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    want = {i: (int(near[k].sum()), comp[i], comp[i] == i) for k, i in enumerate(ids)} | {v[0]: (0, v[0], True) for v in odd}
    assert sum(v[0] for v in want.values()) > 100
    for block in (1024, 16):
        assert rows(op1_embeddings.near_vectors(df, block=block), "vec_id", "n_links", "component_id", "kept") == want
    assert op1_embeddings.near_vectors(df.limit(0)).collect() == []


def test_op1_bound_is_never_below_the_cosine():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(200, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    codes, scale, size, error = op1_embeddings.quantise(unit)
    bound = (codes.astype(float) @ codes.T) * np.outer(scale, scale) + np.outer(size, error) + np.outer(error, size + error)
    assert (bound >= unit @ unit.T).all()


def test_op2_equals_tiktoken_at_any_leaf(spark, docs):
    plain = op2_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    want = {}
    for i, t in docs:
        ids = plain.bpe.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), brute.sha(t or ""))
    for leaf in (3, 64, 2048):
        assert rows(op2_bpe.bpe_round_trip(frame(spark, docs), RANKS, public_tokenizers.PATTERN, leaf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    tokens = op2_bpe.bpe_encode(frame(spark, docs), RANKS, public_tokenizers.PATTERN, 50)
    back = rows(op2_bpe.bpe_decode(tokens, RANKS, public_tokenizers.PATTERN), "doc_id", "data")
    assert {i: bytes(d[0]).decode() for i, d in back.items()} == {i: t or "" for i, t in docs}
    assert op2_bpe.bpe_round_trip(frame(spark, docs).limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_op2_join_of_random_texts():
    import random

    coder, rng = op2_bpe.Codec(RANKS, public_tokenizers.PATTERN, 8), random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice(" '  \n\tabsdvrelm12.!é漢 　🙂") for _ in range(rng.randint(0, 90)))
        assert coder.encode(t) == coder.bpe.encode_ordinary(t)


def test_op3_finds_wordings_and_not_near_misses(spark):
    docs = [(1, "prose here\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, "this driver's licence is blue"), (4, None), (5, ""), (6, "This work is licensed under\nthe GNU General Public License, version 3."), (7, "This work is licensed under the GNU General Public License, version 2."), (8, "Copyright A. Person 1999. All rights reserved."), (2, "Licensed under CC BY-NC 4.0.")]
    got = sorted((r.doc_id, r.line, r.license) for r in op3_licenses.scan_licenses(frame(spark, docs)).collect())
    assert got == [(1, 1, "Apache-2.0"), (2, 0, "CC-BY-NC-4.0"), (2, 0, "CC-BY-NC-4.0"), (6, 0, "GPL-3.0"), (7, 0, "GPL-2.0"), (8, 0, "all-rights-reserved")]
    for name, text in op3_licenses.TEMPLATES.items():
        assert op3_licenses.scan(text)[0] == name
    assert op3_licenses.scan_licenses(frame(spark, docs).limit(0)).collect() == []


def test_op4_components_against_all_pairs(spark, docs):
    assert rows(op4_jaccard.jaccard_components(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == brute.jaccard(docs)
    repeated = docs + docs[:12] + [(None, docs[0][1]), (None, None)]
    got = op4_jaccard.jaccard_components(frame(spark, repeated)).collect()
    assert len(got) == len(repeated)
    assert {tuple(r) for r in got if r.doc_id is not None} == {(i, *v) for i, v in brute.jaccard(docs).items()}
    kept = op4_jaccard.drop_near_duplicates(frame(spark, repeated))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in brute.jaccard(docs).values()})
    assert kept.columns == frame(spark, repeated).columns
    assert op4_jaccard.jaccard_components(frame(spark, docs).limit(0)).collect() == []


def test_op4_tree_finds_all_and_bound_holds():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in rng.integers(1, 300, 60)]
    sets += [np.unique(np.append(s[: max(1, int(len(s) * 0.95))], rng.integers(0, 2**63, 2, dtype=np.uint64))) for s in sets]
    points = [op4_jaccard.unpacked(op4_jaccard.point(s)) for s in sets]
    n = np.array([len(s) for s in sets])
    found = {tuple(sorted(p)) for x, y, _ in op4_jaccard.tree_pairs(points, n, np.arange(len(sets))) for p in zip(x.tolist(), y.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            g = min(len(points[a]), len(points[b]))
            assert np.minimum(op4_jaccard.fold(points[a], g), op4_jaccard.fold(points[b], g)).sum() >= both
            if 100 * both >= 75 * (n[a] + n[b] - both):
                assert (b, a) in found


def test_op5_store_round_trip(spark, docs, tmp_path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = docs + [(500, "Ünïcode, ﬁne! İx 'tis don't <|endoftext|> ²½ ª º µ end."), (501, "a b c " * 20000)]
    path = op5_token_store.write_store(frame(spark, docs), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "store"))
    start, want, ids_of = 0, {}, {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want[i], ids_of[i] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())), ids
        start += len(ids)
    assert rows(op5_token_store.store_digests(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert {r.doc_id: r.ids for r in op5_token_store.read_ids(spark, path).collect()} == ids_of
    assert op5_token_store.verify(spark, path)
    chunks = spark.read.parquet(f"{path}/raw").where("kind = 1")
    assert chunks.count() == chunks.select("addresses").distinct().count()
    empty = op5_token_store.write_store(frame(spark, docs).limit(0), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "empty"))
    assert op5_token_store.store_digests(spark, empty).collect() == []


def test_op5_crcs_combine():
    a, b = os.urandom(1000), os.urandom(77)
    assert op5_token_store.combine_crc(np.array([zlib.crc32(a), 0]), np.array([zlib.crc32(b), zlib.crc32(b)]), np.array([77, 77])).tolist() == [zlib.crc32(a + b), zlib.crc32(b)]


def test_op6_windows_against_all(spark, docs):
    assert sum(v[1] for v in brute.substrings(docs).values()) > 500
    assert rows(op6_substrings.dedup_substrings(frame(spark, docs), with_text=False), "doc_id", "n_words", "n_removed", "kept") == brute.substrings(docs)
    odd = op6_substrings.dedup_substrings(frame(spark, [*docs, docs[0], (None, docs[0][1])])).collect()
    assert len(odd) == len(docs) + 2 and next(r for r in odd if r.doc_id is None).n_removed == 0
    assert op6_substrings.dedup_substrings(frame(spark, docs).limit(0)).collect() == []


def test_op7_lines_against_plain_counts(spark):
    docs = [(i, "\n".join([f"own {i} a", "shared by all  ", f"own {i} b", "" if i % 2 else "two", f"pair {i // 2}"]), f"s{i % 7}") for i in range(40)]
    docs += [(100, None, "s1"), (101, "", "s2"), (102, "shared by all\nshared by all", None), (103, "\n\n", "s3")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash")).withColumn("gone", F.lit(1))
    out = op7_lines.dedup_lines(df, 5)
    want = brute.lines_kept(docs, 5)
    assert rows(out.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "n_lines", "n_removed", "text") == want
    assert sum(v[1] for v in want.values()) >= 40 and want[102][1] == 0
    assert op7_lines.dedup_lines(df.limit(0)).collect() == []


def test_op8_base_spans_against_plain(spark, docs):
    texts = ["mail a@b.c_d@e.f x@y", "ip 1.2.3.4.5 300.1.1.1 0001.2.3.4 1.2.3.4", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713", "tel +1 (988) 555-2485. +12 +4930123456-", "é漢🙂 a.b@c.de 🙂 +1 988 555 2485", "", None, "9" * 3000, "a" * 30000 + "@", "x@y.z" * 50, "call (988) 555-2485 now; order 123-45-6789", "write joe [at] mail [dot] com", "+" * 2000 + "1", "DE89 3704 0044 0532 0130 00 is an account"]
    docs = [*enumerate(texts, 1000), *docs]
    got = rows(op8_pii.find_personal_data(frame(spark, docs)), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t in docs:
        spans = brute.base_spans(t)
        assert got[i][:5] == (*(sum(s.startswith(k + ":") for s in spans) for k in brute.PII), brute.sha(",".join(spans))), t
        assert set(spans) <= set(got[i][5].split(",")) | set([] if spans else spans)
    assert op8_pii.find_personal_data(frame(spark, docs).limit(0)).collect() == []


def test_op8_labelers_learn_their_reliability():
    kind = op8_pii.KINDS.index("phone_local")
    good, bad = [(kind, 1, 1, 1, 3, 400), (kind, 1, 0, 1, 3, 200)], [(kind, -1, 0, -1, 3, 500), (kind, -1, 0, 0, 3, 100)]
    model = op8_pii.SpanModel(good + bad)
    assert model.reliability[kind, 0, 1, 2] > 0.9 and model.reliability[kind, 0, 0, 0] > 0.9
    score = lambda r: op8_pii.SpanModel._features(np.array([r[0]]), np.array([r[1:4]]), np.array([r[4]])) @ model.weights
    assert all(score(r) > 0 for r in good) and all(score(r) < 0 for r in bad)


def test_op9_held_out_accuracy(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        docs.append((i, " ".join(word() for _ in range(80)) if good else (word() + " ") * 60 if i % 8 else " ".join(word().upper() + "!!" for _ in range(60))))
        if i < 400:
            labels.append((i, int(good), 0))
    docs += [(900, None), (901, "")]
    table = spark.createDataFrame(labels + [(5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = op9_quality.fit(frame(spark, docs), table)
    assert model.held_out_accuracy >= 0.97
    got = rows(op9_quality.score(frame(spark, docs), model), "doc_id", "keep")
    assert np.mean([got[i][0] == (i % 4 != 0) for i in range(400, 600)]) >= 0.97 and len(got) == 602
    kept = op9_quality.filter_quality(frame(spark, docs), table)
    assert kept.columns == frame(spark, docs).columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, k in got.items() if k[0]}
    assert op9_quality.fit(frame(spark, docs), table.limit(0)) is None
    assert op9_quality.score(frame(spark, docs).limit(0), None).collect() == []


def test_op10_tolerates_substitutions(spark, docs):
    words = [f"b{k}" for k in range(24)]
    items = [(1, " ".join(words)), (2, "one two three"), (3, None), (4, ""), (5, "five short words right here"), (1, " ".join(words))]
    changed = list(words)
    changed[5], changed[15] = "x", "y"
    far = [w if k % 2 else f"z{k}" for k, w in enumerate(words)]
    words[3], changed[3], far[3] = "École", "École", "École"
    items[0] = items[5] = (1, " ".join(words))
    planted = [(2006, "!! ".join(words).upper() + "!!"), (2000, "pre " + " ".join(words) + " post"), (2001, " ".join(changed).upper()), (2002, " ".join(far)), (2003, " ".join(words[:8])), (2004, "a five short words right here b"), (2005, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 2):
        got = rows(op10_decontaminate.decontaminate(frame(spark, docs + planted), bench, block), "doc_id", "contaminated", "item_ids")
        assert {i: v[1] for i, v in got.items() if v[0]} == {2000: [1], 2001: [1], 2004: [5], 2006: [1]}
    kept = op10_decontaminate.filter_contaminated(frame(spark, docs + planted), bench)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, _ in docs} | {2002, 2003, 2005}
    assert not any(v[0] for v in rows(op10_decontaminate.decontaminate(frame(spark, docs), bench.limit(0)), "doc_id", "contaminated").values())
