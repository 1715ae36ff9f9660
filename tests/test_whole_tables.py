"""Queries whose feature is no filter give the whole table: as many rows as the table calls for, each as DuckDB has it."""

import duckdb
import pytest

import __spark_entry__ as entry

from .test_entry import SF, plain

ROWS = {
    "scan_unnest": "SELECT sum(len(embedding)) FROM embeddings",
    "pred_is_empty": "SELECT count(*) FROM embeddings WHERE len(embedding) > 0",
    "expr_arith": "SELECT count(*) FROM lineitem",
    "expr_at_time_zone": "SELECT count(*) FROM orders",
    "expr_dates": "SELECT count(*) FROM orders",
    "agg_json": "SELECT count(DISTINCT n_regionkey) FROM nation",
    "unpivot_basic": "SELECT count(l_tax) + count(l_discount) FROM lineitem",
}


@pytest.mark.parametrize("name", ROWS)
def test_query_reads_the_whole_table(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert len(got) == con.execute(ROWS[name]).fetchone()[0]
    if name == "agg_json":
        assert sum(r.a.count(",") + 1 for r in df.collect()) == con.execute("SELECT count(*) FROM nation").fetchone()[0]
    ran = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in ran.fetchall()), key=repr)
