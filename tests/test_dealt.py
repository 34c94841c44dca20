"""Forms dealt by a key, what evidence and shares shuffle, and both against their SQL on odd tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_shared_numbers import _rows
from tidemark.plans import registry
from tidemark.plans.corpus import TABLES, VIEWS, frame

SF = "/root/testdata/sf0.001"
VIEW_OF = {"number_prs": "prs", "number_reviews": "reviews", "number_keys": "pr_keys", "ticket_keys": "pr_keys", "ticket_issues": "issues", "ticket_moves": "changelog", "ticket_prs": "prs", "ticket_pushes": "commits", "ticket_commits": "commits", "ticket_comments": "comments", "ticket_links": "issue_links"}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """With nulls in what requests, files and keys are made of."""
    return _tables(tmp_path_factory.mktemp("odd"), ("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus"))


@pytest.fixture(scope="module")
def missing(tmp_path_factory):
    """With nulls in all columns that views are made of."""
    return _tables(tmp_path_factory.mktemp("missing"), ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus"))


def _tables(folder, columns):
    """Suppliers that share numbers, rows given twice, missing and risky paths."""
    con = duckdb.connect()
    some = lambda c, k: f"CASE WHEN hash(l_orderkey, l_partkey, {k}) % 23 = 0 THEN NULL ELSE {c} END AS {c}"
    shared = "CASE WHEN hash(l_orderkey, l_partkey, 99) % 23 = 0 THEN NULL ELSE l_suppkey + 10000 * ((l_orderkey + l_linenumber) % 3) END AS l_suppkey"
    changes = {
        "lineitem": f"SELECT * REPLACE ({', '.join(some(c, k) for k, c in enumerate(columns))}, {shared}) FROM '{SF}/lineitem.parquet'",
        "supplier": f"SELECT * REPLACE (s_suppkey + 10000 * i AS s_suppkey) FROM '{SF}/supplier.parquet', range(3) r(i)",
        "part": f"SELECT * REPLACE (CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'promo auth' ELSE p_name END AS p_name, CASE WHEN p_partkey % 5 = 0 THEN 'auth lib' ELSE p_type END AS p_type) FROM '{SF}/part.parquet'",
    }
    changes["lineitem"] += f" UNION ALL SELECT * FROM ({changes['lineitem']}) WHERE l_linenumber < 3"
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"COPY ({changes.get(t, f'SELECT * FROM {chr(39)}{SF}/{t}.parquet{chr(39)}')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
            con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    return con, str(folder)


@pytest.mark.parametrize("name", VIEW_OF)
def test_forms(spark, missing, name):
    """Each form has the rows of its view; of keys and times of commits, those that are named, each once."""
    view, own = VIEW_OF[name], lambda df: df
    if view == "pr_keys":
        own = lambda df: df.select("repo", "pr_number", F.upper("issue_key").alias("issue_key")).where("issue_key IS NOT NULL").distinct()
    elif name == "ticket_pushes":
        own = lambda df: df.distinct()
    tables = {n: frame(spark, missing[1], n) for n in ("lineitem", "orders") if f"{{{n}}}" in VIEWS[view]}
    got, want = own(frame(spark, missing[1], name)), own(spark.sql(VIEWS[view], **tables))
    got = got.select(*want.columns)
    assert got.dtypes == want.dtypes and want.count() > 0
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", ("ticket_evidence", "ticket_band", "audit_band_patterns", "ticket_upsert", "audit_movers_by_glob", "epic_shares", "epic_shares_surging"))
def test_odd_tables(spark, odd, name):
    con, folder = odd
    assert _rows(registry.QUERIES[name](spark, folder).toPandas()) == _rows(con.sql(registry.ORACLES[name]).df())


def _shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", ("epic_shares", "epic_shares_surging", "ticket_evidence", "ticket_upsert", "ticket_post", "audit_band_patterns", "ticket_facets_more", "ticket_calibrate", "ticket_overrides", "audit_movers_by_glob", "ticket_band"))
def test_shuffled(spark, name):
    """Bytes shuffled for each line: each source is exchanged once, by numbers."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    before = _shuffled(spark)
    registry.QUERIES[name](spark, SF).collect()
    each = (_shuffled(spark) - before) / lines
    assert 0 < each < LIMIT[name]


LIMIT = dict.fromkeys(("epic_shares", "epic_shares_surging"), 200) | dict.fromkeys(("ticket_evidence", "ticket_upsert", "ticket_post", "audit_band_patterns", "ticket_facets_more", "ticket_calibrate", "ticket_overrides", "audit_movers_by_glob", "ticket_band"), 220)
