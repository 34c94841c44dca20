"""Month-partitioned corpora: JSON cells, columnar cells, manifests and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_corpus_json(spark: SparkSession, root: str, source: str, schema: StructType | str) -> DataFrame:
    """Cells ``{root}/{source}/{scope}/{month}.json`` of JSON arrays, with scope and month from the path; no cell, no rows."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    path = F.col("_metadata.file_path")
    part = lambda n: F.regexp_extract(path, r"([^/]+)/(\d{4}-\d{2})\.json$", n)
    return reader.json(f"{root}/{source}").withColumns({"scope": part(1), "month": part(2)})


def load_corpus(spark: SparkSession, path: str, first: str, last: str, scopes: list[str] | None = None) -> DataFrame:
    """Columnar cells of a range of months: the filters prune partitions."""
    if last < first:
        raise ValueError("the range ends before it starts")
    rows = spark.read.parquet(path).where((F.col("month") >= first) & (F.col("month") <= last))
    return rows.where(F.col("scope").isin(*scopes)) if scopes else rows


def write_cells(df: DataFrame, path: str) -> None:
    """Rewrites whole (scope, month) cells; others stay as they are."""
    df.write.partitionBy("scope", "month").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def children(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """An array of structs as a child table with its order; a null array (not fetched) has no rows."""
    return df.select(*key, F.posexplode(column).alias("ord", "_c")).select(*key, "ord", "_c.*")


def cell_manifest(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy("scope", "month").agg(F.count("*").alias("records")).select(F.lit(source).alias("source"), "scope", "month", "records")


def month_bounds(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("source").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.sum("records").alias("records"))


def stale_cells(grid: DataFrame, manifest: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Adds ``stale``: forced, absent, the current month, captured before the month closed, or the month just closed up to the 7th."""
    rows = grid.join(manifest.select("scope", "month", "pulled_at"), ["scope", "month"], "left")
    current = F.date_format(now, "yyyy-MM")
    closed = F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1)
    before = F.date_format(F.add_months(now, -1), "yyyy-MM")
    stale = F.lit(force) | F.col("pulled_at").isNull() | (F.col("month") == current) | (F.col("pulled_at") < closed) | ((F.col("month") == before) & (F.dayofmonth(now) <= 7))
    return rows.withColumn("stale", stale)


def carry_forward(existing: DataFrame, fresh: DataFrame, key: str, detail: list[str]) -> DataFrame:
    """``fresh`` with the details of unchanged rows that were fetched before; keys that are no longer there go."""
    old = existing.select(F.col(key).alias("_k"), F.col("updated").alias("_u"), *[F.col(c).alias(f"_{c}") for c in detail])
    same = (F.col("updated") == F.col("_u")) & F.col(f"_{detail[0]}").isNotNull()
    rows = fresh.join(old, F.col(key) == F.col("_k"), "left")
    return rows.withColumns({c: F.when(same, F.col(f"_{c}")).otherwise(F.col(c)) for c in detail}).select(*fresh.columns)


def needs_detail(df: DataFrame, detail: str) -> DataFrame:
    """Per cell: rows that still lack a detail."""
    return df.groupBy("scope", "month").agg(F.sum(F.col(detail).isNull().cast("long")).alias("missing"), F.count("*").alias("records"))


def integrity(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(scope, month, problem): missing, unlisted or miscounted cells."""
    both = manifest.select("scope", "month", F.col("records").alias("listed")).join(files.select("scope", "month", F.col("records").alias("found")), ["scope", "month"], "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") != F.col("found"), "miscounted")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("scope", "month", "problem")


def json_to_columnar(spark: SparkSession, root: str, path: str, sources: dict[str, tuple[StructType | str, tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """Imports a JSON corpus: ``sources`` gives each source's schema, key columns and child arrays.

    Each source becomes cells at ``{path}/{source}`` and each child array a table at ``{path}/{source}_{child}``.  Cells are
    rewritten whole, so a second import changes nothing.  Returns (source, scope, month, records) of what was imported."""
    tallies = None
    for source, (schema, key, arrays) in sources.items():
        rows = read_corpus_json(spark, root, source, schema)
        write_cells(rows.drop(*arrays), f"{path}/{source}")
        for child in arrays:
            write_cells(children(rows, [*key, "scope", "month"], child), f"{path}/{source}_{child}")
        own = cell_manifest(spark.read.parquet(f"{path}/{source}"), source)
        tallies = own if tallies is None else tallies.unionByName(own)
    return tallies


def export_scores(scores: DataFrame, path: str) -> None:
    """All score rows as JSON lines, by ticket."""
    scores.orderBy("ticket").write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
