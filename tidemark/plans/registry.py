"""All registered queries of the analyses and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import activity, content, delivery, views
from tidemark.plans.corpus import frame, oracle

GROUPS = (activity.QUERIES, delivery.QUERIES, content.QUERIES, views.QUERIES)


def _bound(build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(lambda name: frame(spark, sf_dir, name))

    return run


QUERIES = {name: _bound(build) for group in GROUPS for name, (build, _) in group.items()}
ORACLES = {name: oracle(sql) for group in GROUPS for name, (_, sql) in group.items() if sql}
