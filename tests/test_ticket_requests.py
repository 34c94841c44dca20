"""The requests of a ticket against their SQL on tables with missing lines and with shared numbers."""

import re

import duckdb
import pytest

from tidemark.plans import registry

LINES = "/root/testdata/sf0.001/lineitem.parquet"
ODD = {
    # orders divisible by 3 have no quantities; those divisible by 5 none in suppliers of an even key
    "quantity": "CASE WHEN l_orderkey % 3 = 0 OR l_orderkey % 5 = 0 AND l_suppkey % 2 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
    "line number": "CASE WHEN l_orderkey % 3 = 0 OR l_suppkey % 4 = 1 THEN NULL ELSE l_linenumber END AS l_linenumber",
}


def _both(spark, folder, change):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE ({change}) FROM '{LINES}') TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS FROM '{folder}/lineitem.parquet'")
    rows = registry.QUERIES["ticket_requests"](spark, str(folder)).collect()
    return [tuple(r) for r in rows], con.execute(registry.ORACLES["ticket_requests"]).fetchall()


@pytest.mark.parametrize("column", ODD)
def test_missing_lines(spark, tmp_path, column):
    got, want = _both(spark, tmp_path, ODD[column])
    assert any(requests is None for _, requests in want) and any(requests for _, requests in want)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_requests_of_one_number(spark, tmp_path):
    """The SQL leaves open how requests of one number follow each other: all else is equal, and the query orders them by lines."""
    got, want = _both(spark, tmp_path, "l_suppkey + 10000 * ((l_orderkey + l_linenumber) % 3) AS l_suppkey")
    split = lambda rows: {key: [tuple(int(v) if v.isdigit() else v for v in x.split(":")) for x in requests.split(";")] for key, requests in rows}
    numbers = lambda rows: sorted((key, re.sub(r":\d+:\d+(?=;|$)", "", requests)) for key, requests in rows)
    assert any(len({x[:2] for x in items}) < len(items) for items in split(want).values())
    assert len(got) == len(want) and numbers(got) == numbers(want)
    assert split(got) == {key: sorted(items) for key, items in split(want).items()}
