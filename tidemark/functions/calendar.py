"""Calendar labels and axes: months, ISO weeks, quarters and bi-weekly periods, as column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(ts: Column | str) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def month_key(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def month_start(ts) -> Column:
    return F.trunc(_c(ts), "MM")


def quarter_label(ts) -> Column:
    return F.concat(F.year(_c(ts)).cast("string"), F.lit("-Q"), F.quarter(_c(ts)).cast("string"))


def week_start(ts) -> Column:
    """The Monday of a timestamp's week, as a date."""
    return F.trunc(_c(ts).cast("date"), "WEEK")


def week_year(ts) -> Column:
    return F.year(F.date_add(week_start(ts), 3))  # the ISO year is the year of the week's Thursday


def iso_week(ts) -> Column:
    return F.format_string("%04d-W%02d", week_year(ts), F.weekofyear(_c(ts)))


def week_ordinal(ts) -> Column:
    """Weeks since Monday 1970-01-05: differences count weeks across years."""
    return F.floor(F.datediff(week_start(ts), F.lit("1970-01-05").cast("date")) / 7).cast("long")


def period_label(ts) -> Column:
    """ISO weeks paired odd and even within the ISO year; week 53 stands alone."""
    week = F.weekofyear(_c(ts))
    return F.format_string("%04d-P%02d", week_year(ts), week - 1 + week % 2)


def period_start(ts) -> Column:
    return F.date_sub(week_start(ts), ((F.weekofyear(_c(ts)) + 1) % 2) * 7)


def period_end(ts) -> Column:
    """The first day after the period."""
    return F.date_add(period_start(ts), F.when(F.weekofyear(_c(ts)) == 53, 7).otherwise(14))


def week_to_month(label) -> Column:
    """The month in which a week label's week lies, coarsely: 4 January plus so many weeks."""
    year, week = F.substring(_c(label), 1, 4).cast("int"), F.substring(_c(label), 7, 2).cast("int")
    return F.date_format(F.date_add(F.make_date(year, F.lit(1), F.lit(4)), 7 * (week - 1)), "yyyy-MM")


def in_months(ts, first, last) -> Column:
    """A half-open range that reaches the scan: first and last are month starts, both included."""
    return (_c(ts) >= first) & (_c(ts) < F.add_months(last, 1))


def month_spine(bounds: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """One row (month: date) per month from one row of bounds."""
    return bounds.select(F.explode(F.expr(f"sequence(trunc({first}, 'MM'), trunc({last}, 'MM'), interval 1 month)")).alias("month"))


def week_spine(bounds: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Mondays from the week that covers the first day."""
    return bounds.select(F.explode(F.expr(f"sequence(cast(date_trunc('WEEK', {first}) as date), cast(date_trunc('WEEK', {last}) as date), interval 7 days)")).alias("week"))


def period_spine(bounds: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """(period, start, stop) in order, each once."""
    weeks = week_spine(bounds, first, last)
    return weeks.select(period_label("week").alias("period"), period_start("week").alias("start"), period_end("week").alias("stop")).distinct()


def completed_periods(spine: DataFrame, now: Column) -> DataFrame:
    return spine.where(F.col("stop") <= F.to_date(now))


RANGES = {"3m": 3, "6m": 6, "12m": 12, "24m": 24}


def resolve_range(bounds: DataFrame, names: list[str], current: str = "last", first: str = "first") -> DataFrame:
    """(name, start, stop) as month starts, clamped to the first month."""
    now, least = month_start(current), month_start(first)
    starts = [F.struct(F.lit(n).alias("name"), (F.add_months(now, 1 - RANGES[n]) if n in RANGES else F.trunc(now, "YEAR") if n == "ytd" else least).alias("start")) for n in names]
    rows = bounds.select(F.explode(F.array(*starts)).alias("r"), now.alias("stop"), least.alias("least"))
    return rows.select("r.name", F.greatest("r.start", "least").alias("start"), "stop")


def bounds_of(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def comparison_windows(first: date, last: date) -> list[tuple[str, str, str]]:
    """Named half-open ranges around the months first to last (their first days): the window itself, as many months before
    it, the same months a year and a quarter earlier, and the four quarters up to its last month."""
    at = lambda n: date(n // 12, n % 12 + 1, 1).isoformat()
    a, b = first.year * 12 + first.month - 1, last.year * 12 + last.month
    quarter = (b - 1) // 3 * 3
    ranges = [("current", a, b), ("prior", a - (b - a), a), ("yoy", a - 12, b - 12), ("qoq", a - 3, b - 3)]
    ranges += [(f"{(quarter - 3 * k) // 12}-Q{(quarter - 3 * k) % 12 // 3 + 1}", quarter - 3 * k, quarter - 3 * k + 3) for k in range(4)]
    return [(name, at(x), at(y)) for name, x, y in ranges]


def period_close(label) -> Column:
    """The day on which a period (by its label) is over: two weeks after its first Monday, one for a week 53."""
    year, week = F.substring(_c(label), 1, 4).cast("int"), F.substring(_c(label), 7, 2).cast("int")
    first = F.date_trunc("WEEK", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    return F.date_add(first, 7 * (week - 1) + F.when(week == 53, 7).otherwise(14))


def windows_frame(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(window, start, stop) of named half-open ranges: a handful of rows."""
    return spark.createDataFrame(rows, "window string, start string, stop string").select("window", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"))
