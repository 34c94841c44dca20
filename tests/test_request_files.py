"""The impacts by requests with their files, forms of views for Spark, and sums by person: against what they stand for."""

import pytest
from pyspark.sql import functions as F

from tests.test_shared_numbers import _rows, shared  # noqa: F401
from tidemark.config import Impact
from tidemark.operators import impact, people
from tidemark.plans import registry
from tidemark.plans.corpus import FORMS, VIEWS, frame
from tidemark.sources import staging


@pytest.mark.parametrize("name", ("code_impact", "effort_multiplier", "score_breakdown"))
def test_shared_numbers(spark, shared, name):  # noqa: F811
    """The SQL has a weight for each row of a number, so lines of requests that share one count as often."""
    con, folder = shared
    assert _rows(registry.QUERIES[name](spark, folder).toPandas()) == _rows(con.sql(registry.ORACLES[name]).df())


def test_sides_share_requests(spark):
    before = staging.count_staged()
    registry.QUERIES["audit_impact"](spark, "/root/testdata/sf0.001")
    names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in staging._PATHS[before:]]
    assert names.count("request-files") == names.count("cohort") == 1
    assert not {"prs", "pr_files", "file-marks"} & set(names)


@pytest.mark.parametrize("name", ("dump", "families", "none"))
def test_effective(spark, name):
    """As the impacts over rows of files: dumps, generated and outsized files, families, missing lines, requests without files."""
    knobs = Impact(dump_files=3, dump_share=0.6, dump_weight=0.1, dump_ceiling=50, deletion_weight=0.5, family_members=3 if name == "families" else 10**9)
    day = "2024-01-02"
    prs = [("r", 1, "a", day, 20, 4), ("r", 2, "a", day, 9, 1), ("r", 3, "b", day, 100, 0), ("r", 4, "b", None, 7, 7), ("r", 5, "b", day, 6, 2), ("q", 1, "c", day, 30, 3), ("q", 6, "c", day, None, None)]
    paths = ["x/ab-one.go", "x/cd-one.go", "x/ef-one.go", "x/yarn.lock", "d/a.json", "d/b.json", "d/c.json", "d/big.xml"]
    lines = [("r", 1, 0, 3.0), ("r", 1, 0, 2.0), ("r", 1, 1, 5.0), ("r", 1, 2, 5.0), ("r", 2, 3, 4.0), ("r", 2, 1, 1.0), ("r", 4, 2, 9.0), ("q", 1, 7, 99.0), ("q", 1, 0, 2.0), ("q", 6, 1, None)]
    lines += [("r", 3, k, 8.0) for k in ((4, 5, 6, 0) if name == "dump" else (4, 0))]
    prs = spark.createDataFrame(prs, "repo string, pr_number long, author string, merged string, additions long, deletions long").withColumn("created", F.lit(day))
    raw = spark.createDataFrame(lines, "repo string, pr_number long, file long, additions double").withColumns({"added": F.col("file") != 3, "deletions": F.when(F.col("additions").isNotNull(), 2)})
    parts = spark.createDataFrame(list(enumerate(paths)), "file long, path string")
    logins = spark.createDataFrame([("A", "a"), ("A", "c"), ("B", "b")], "dev string, login string")
    files = raw.join(parts, "file").groupBy("repo", "pr_number", "path").agg(F.when(F.min("added"), "added").otherwise("modified").alias("status"), F.sum("additions").cast("long").alias("additions"), F.sum("deletions").cast("long").alias("deletions"))
    names, kinds = impact.named_paths(parts)
    rows = staging.staged(impact.request_files(prs, raw, kinds, knobs), "test-requests")
    assert rows.where("lead").count() == prs.count()
    got = {r.dev: r for r in impact.effective(rows, logins, [staging.staged(impact.families(rows, names, knobs), "test-families")]).collect()}
    own = people.attribute_github(prs, logins, "author")
    files_of = {r.dev: r for r in impact.effective_files(own, prs, files, knobs).collect()}
    loc_of = {r.dev: r.effective_loc for r in impact.effective_loc(own, prs, files, knobs).collect()}
    assert set(got) == {"A", "B"}
    for dev, r in got.items():
        assert (r.unique_files, r.effective_files_0) == (files_of[dev].unique_files, pytest.approx(files_of[dev].effective_files))
        assert r.effective_loc_0 == pytest.approx(loc_of[dev])


@pytest.mark.parametrize("name", ("prs", "commits", "pr_files"))
def test_forms(spark, tmp_path, name):
    """Rows given twice, and nulls in each column that a view names rows by."""
    sf = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 40 = 1")
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus"):
        some = some.unionAll(some.where("l_orderkey % 80 = 1 AND l_linenumber < 4").withColumn(c, F.lit(None).cast(some.schema[c].dataType)))
    some.unionAll(some.where("l_linenumber < 3")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{sf}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    assert FORMS[name] != VIEWS[name]
    want = spark.sql(VIEWS[name], lineitem=frame(spark, str(tmp_path), "lineitem"), **({"part": frame(spark, str(tmp_path), "part")} if name == "pr_files" else {}))
    got = frame(spark, str(tmp_path), name)
    assert got.dtypes == want.dtypes and want.count() > 0
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_labels_once_a_period(spark):
    """No label is made of a fact: the one of a period comes after its sums."""
    plan = registry.QUERIES["period_totals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") == 1
