"""op7's scratch tables of known length: files by their rows, not by partitions (each file starts helper processes)."""

from pyspark.sql import functions as F

from gridloom.llm import op7_lines
from gridloom.llm.common import FEWEST
from tests.llm import brute
from tests.llm.test_lines_rows import SCHEMA, corpus, result


def test_op7_writes_few_files_over_many_partitions(spark, monkeypatch):
    files, table = [], op7_lines.table

    def counted(df, *args, **kwargs):
        out = table(df, *args, **kwargs)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(op7_lines, "table", counted)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        docs = corpus()
        got = result(op7_lines.dedup_lines(spark.createDataFrame(docs, SCHEMA).repartition(40, F.col("doc_id"))))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute.lines_kept(docs, 5)
    assert len(files) > 1 and all(n <= FEWEST for n in files[1:]), files  # the first table's length isn't known before
