"""Short pages of boilerplate, copies, equal doc_ids, hot lines, and the plan of the sketches."""

import duckdb
from pyspark.sql import functions as F

from gridloom.llm import op7_lines
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string"


def corpus():
    nav = ["Home", "About", "Contact"]
    docs = [(i, "\n".join([*nav, f"this is the own text of page {i}", f"and this is some more of page {i}"]), f"s{i % 9}") for i in range(60)]
    copy = "a whole text that stands\nat very many sites\nin three lines"
    docs += [(100 + i, copy if i % 2 else copy.replace("very many", f"very {i} many"), f"s{i % 7}") for i in range(30)]
    docs += [(200 + i, f"line of four sites\nown {i}\nof four and five words {i % 4}", f"s{i % 4}") for i in range(20)]
    docs += [(300 + i, f"line of five sites\nown {i}", f"s{i % 5}") for i in range(20)]
    return docs


def result(df):
    return {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in df.collect()}


def test_op7_boilerplate_and_copies(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = result(op7_lines.dedup_lines(df))
    assert got == brute.lines_kept(docs, 5)
    assert all(got[i][1] == 3 for i in range(60)) and all(got[100 + i][1] == 0 for i in range(30))
    assert all(got[200 + i][1] == 0 for i in range(20)) and all(got[300 + i][1] in (0, 1) for i in range(20))


def test_op7_rows_of_one_doc_id(spark):
    docs = corpus()
    a, b = "Home\n" + "x" * 30, "y" * 30 + "\nmore\nAbout\n"
    df = spark.createDataFrame([*docs, (900, a, "s1"), (900, b, "s1"), (900, a, "s1"), (None, a, "s2"), (None, None, "s2")], SCHEMA)
    got = sorted((r.n_lines, r.n_removed, r.text) for r in op7_lines.dedup_lines(df).where("doc_id = 900").collect())
    assert got == [(2, 1, "x" * 30)] * 2 + [(3, 1, "y" * 30 + "\nmore\n")]
    assert sorted((r.n_lines, r.n_removed) for r in op7_lines.dedup_lines(df).where("doc_id IS NULL").collect()) == [(0, 0), (2, 0)]


def test_op7_equals_its_sql(spark, tmp_path):
    df = spark.createDataFrame(corpus(), SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = op7_lines.op7_lines(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({op7_lines.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_op7_sketches_are_of_all_occurrences(spark):
    """The sketch aggregation reads the lines as they are; nothing below it is distinct."""
    lines = spark.createDataFrame(corpus(), SCHEMA)
    h = op7_lines._exploded(lines).select("h", "site")
    plan = h.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(op7_lines.LG_K)))._jdf.queryExecution().executedPlan().toString()
    assert "hll_sketch_agg" in plan.lower() and plan.count("HashAggregate") == plan.count("ObjectHashAggregate")
    assert {r.sites >= 5 for r in op7_lines.spread_lines(lines).collect()} == {True}
