"""Profiles of untyped fields: which are populated, with what shape, and which are worth capturing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def raw_fields(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, field_id, value_json) of a JSON object's fields."""
    fields = F.from_json(json, "map<string,string>")
    return df.select(key, F.explode(fields).alias("field_id", "value_json"))


def is_populated(value: Column) -> Column:
    """Null, blank, empty lists and objects, false and zero are not."""
    return value.isNotNull() & ~F.trim(value).isin("", "null", "[]", "{}", "false", "0", "0.0", '""')


def shape(value: Column) -> Column:
    v = F.trim(value)
    return (
        F.when(v.startswith("["), F.concat(F.lit("array["), F.json_array_length(v).cast("string"), F.lit("]")))
        .when(v.startswith("{"), F.concat(F.lit("object{"), F.array_join(F.slice(F.json_object_keys(v), 1, 6), ","), F.lit("}")))
        .when(v.rlike(r"^-?\d+(\.\d+)?$"), "number")
        .when(v.isin("true", "false"), "bool")
        .otherwise("string")
    )


def profile(rows: DataFrame) -> DataFrame:
    """(field_id, sampled, populated, shape): the most frequent shape, the smaller name of equals."""
    marked = rows.withColumns({"ok": is_populated(F.col("value_json")), "shape": shape(F.col("value_json"))})
    counts = marked.groupBy("field_id", "shape").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("p"))
    return counts.groupBy("field_id").agg(F.sum("n").alias("sampled"), F.sum("p").alias("populated"), F.min_by("shape", F.struct(-F.col("n"), "shape")).alias("shape"))


def worth_capturing(found: DataFrame, least_share: float = 0.05) -> DataFrame:
    """Adds ``worth``: populated in enough of the rows sampled."""
    return found.withColumn("worth", (F.col("populated") > 0) & (F.col("populated") >= least_share * F.col("sampled")))


def proposals(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """(role, field_id, name): the field that fits each role best by its catalog name and kind; the most populated, then the smaller id."""
    name = F.lower("name")
    role = (
        F.when(name.rlike("story ?points?|estimate") & (F.col("kind") == "number"), "story_points")
        .when(name.rlike("epic link|parent"), "epic_link")
        .when(name.rlike("description") & (F.col("kind") == "string"), "description")
    )
    rows = found.join(catalog, "field_id").withColumn("role", role).where("role IS NOT NULL AND populated > 0")
    return rows.groupBy("role").agg(F.min_by(F.struct("field_id", "name"), F.struct(-F.col("populated"), "field_id")).alias("f")).select("role", "f.*")


#: The names that trackers give to the fields of these roles.
POINT_NAMES = ("story points", "story point estimate")


def mappings(found: DataFrame, catalog: DataFrame, settable: DataFrame) -> DataFrame:
    """(role, field_id, name, populated, sampled, settable, warning): the field that each role maps to.

    ``found`` is a ``profile``, ``catalog`` has (field_id, name, ord) and ``settable`` (field_id, name, n): on how many sampled
    records a field can be set.  Points are written, so they go to the field of such a name that is settable on the most, then
    the first name; only without any to the first of the catalog, with a warning.  The epic link is read: the first of the
    catalog by that name, else the built-in parent.  The description is the most populated field with that word in its name,
    then the first name; without any in the profile the first of the catalog."""
    plain = F.lower(F.trim("name"))
    points, link, words = plain.isin(*POINT_NAMES), plain == "epic link", F.contains(plain, F.lit("description"))
    counts = found.select("field_id", "populated", "sampled")
    pick = lambda df, when, role, turn, *by: df.where(when).agg(F.min_by(F.struct("field_id", "name"), F.struct(*by)).alias("f")).where("f IS NOT NULL").select(F.lit(role).alias("role"), F.lit(turn).alias("turn"), "f.*")
    known = counts.join(catalog, "field_id")
    options = [
        pick(settable, points, "story_points", 0, (-F.col("n")).alias("n"), "name", "field_id"), pick(catalog, points, "story_points", 1, "ord", "field_id"),
        pick(catalog, link, "epic_link", 0, "ord", "field_id"), pick(known, words, "description", 0, (-F.col("populated")).alias("p"), "name", "field_id"), pick(catalog, words, "description", 1, "ord", "field_id"),
    ]
    options.append(found.sparkSession.sql("SELECT 'epic_link' AS role, 1 AS turn, 'parent' AS field_id, 'Parent' AS name"))
    rows = options[0]
    for more in options[1:]:
        rows = rows.unionByName(more)
    best = rows.groupBy("role").agg(F.min(F.struct("turn", "field_id", "name")).alias("b")).select("role", "b.*")  # a row for each role
    best = best.join(counts, "field_id", "left").join(settable.select("field_id", F.col("n").alias("settable")), "field_id", "left").fillna(0, ["populated", "sampled", "settable"])
    return best.select("role", "field_id", "name", "populated", "sampled", "settable", ((F.col("role") == "story_points") & (F.col("turn") > 0)).alias("warning"))
