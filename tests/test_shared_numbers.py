"""Queries against their SQL on tables in which different requests of a repository bear one number."""

import os

import duckdb
import pytest

from tidemark.plans import registry
from tidemark.plans.corpus import TABLES

SF = "/root/testdata/sf0.001"
NAMES = ("integration_classified", "epic_momentum", "epic_weeks", "impact_effective_loc_knobs", "ticket_evidence", "ticket_band")


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """Numbers are orders times 10000 plus suppliers: suppliers of above 10000 share those of later orders."""
    folder, con = tmp_path_factory.mktemp("shared"), duckdb.connect()
    for t in TABLES:
        if not os.path.exists(f"{SF}/{t}.parquet"):
            continue
        rows = f"SELECT * FROM '{SF}/{t}.parquet'"
        if t == "lineitem":
            rows = f"SELECT * REPLACE (l_suppkey + 10000 * ((l_orderkey + l_linenumber) % 3) AS l_suppkey, TIMESTAMP '1996-03-01' + l_partkey % 3 * INTERVAL 1 DAY AS l_shipdate, 'F' AS l_linestatus) FROM '{SF}/{t}.parquet'"
        elif t == "supplier":
            rows = f"SELECT * REPLACE (s_suppkey + 10000 * i AS s_suppkey) FROM '{SF}/{t}.parquet', range(3) r(i)"
        con.sql(f"COPY ({rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    return con, str(folder)


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).astype(str).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", NAMES)
def test_shared_numbers(spark, shared, name):
    con, folder = shared
    assert con.sql("SELECT count(*) > count(DISTINCT n) FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_orderkey * 10000 + l_suppkey AS n FROM lineitem)").fetchall() == [(True,)]
    assert _rows(registry.QUERIES[name](spark, folder).toPandas()) == _rows(con.sql(registry.ORACLES[name]).df())
