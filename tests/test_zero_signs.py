"""Values that round to zero in arrays: their sign is the SQL's, bit for bit."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom.plans import catalogue, more  # noqa: F401


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Eight frames and twelve events whose values round to 0.0, to -0.0, or not to zero."""
    d = tmp_path_factory.mktemp("zeros")
    values = [-1e-8, 1e-8, -0.0, 0.0, -0.25, 4e-7, -4e-7]
    embedding = [[values[(n + k) % 7] for k in range(64)] for n in range(8)]
    pq.write_table(pa.table({"vec_id": range(8), "embedding": pa.array(embedding, pa.list_(pa.float32())), "label": pa.array([0] * 8, pa.int32())}), d / "embeddings.parquet")
    ts = [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k) for k in range(12)]
    pq.write_table(pa.table({"event_id": range(12), "ts": pa.array(ts, pa.timestamp("us")), "user_id": [3] * 12, "value": [values[k % 7] for k in range(12)]}), d / "events.parquet")
    return d


@pytest.mark.parametrize("name", ["stack_field_cells", "stack_cell_fields", "windows_samples", "windows_unrolled", "window_head_tail_extend"])
def test_zeros_in_arrays_keep_the_sign_of_the_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    found = con.sql(catalogue.oracle_sql()[name])
    want = sorted(repr(r) for r in found.fetchall())
    df = catalogue.queries()[name](spark, str(tables)).select(*found.columns)
    assert "-0.0" in str(want) and sorted(repr(tuple(r)) for r in df.collect()) == want
