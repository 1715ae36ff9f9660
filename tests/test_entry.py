"""Registered queries against DuckDB, one or two of each kind."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = (
    "scan_unnest scan_json_table pred_all pred_not_in_subquery expr_dates join_partition_outer join_oracle_plus agg_cube agg_listagg agg_keep win_first_last "
    "win_range_frame limit_percent set_chain cte_search_depth cte_with_function hier_connect_by unpivot_basic fn_instr_pos_occ fn_add_months fn_json_array "
    "fn_concat fn_unistr agg_xml win_lag_diff expr_bind_params plsql_exceptions plsql_forall dict_columns ddl_create_table seq_nextval transfer_convert "
    "multiset_ops map_methods dml_merge dml_insert_all select_into chk_foreign_key sink_tsv_roundtrip aq_recipient_accessors"
).split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    try:
        f = float(v)
        return "nan" if math.isnan(f) else float(f"{f:.9g}")
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
