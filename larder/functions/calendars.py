"""Date expressions: Easter, holidays, retail events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: Danish public holidays, as days from Easter Sunday or as month and day;
# the great prayer day was abolished after 2023
EASTER_HOLIDAYS = [(-3, "Skærtorsdag"), (-2, "Langfredag"), (0, "Påskedag"), (1, "Anden påskedag"),
                   (26, "Store bededag"), (39, "Kristi himmelfartsdag"), (49, "Pinsedag"), (50, "Anden pinsedag")]
FIXED_HOLIDAYS = [(1, 1, "Nytårsdag"), (12, 25, "Juledag"), (12, 26, "Anden juledag")]
PRAYER_DAY_LAST_YEAR = 2023


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar: the Sunday after the paschal full moon.

    The moon's age comes from the 19-year cycle with the two century corrections;
    the full moon falls 0 to 29 days after 21 March.
    """
    y = year.cast("int")
    century = F.floor(y / 100)
    lunar = F.floor((century * 8 + 13) / 25)
    epact = (century - F.floor(century / 4) - lunar + (y % 19) * 19 + 15) % 30
    moon = epact - F.when((epact == 29) | ((epact == 28) & (y % 19 >= 11)), 1).otherwise(0)
    full = F.date_add(F.make_date(y, F.lit(3), F.lit(21)), moon.cast("int"))
    return F.next_day(full, "SUN")


def holidays(years: DataFrame, year_col: str = "year") -> DataFrame:
    """(date, holiday_name) of each year in ``years``."""
    y = F.col(year_col)
    sunday = easter(y)
    moving = [F.struct(F.date_add(sunday, k).alias("date"), F.lit(n).alias("holiday_name"),
                       F.lit(n == "Store bededag").alias("prayer")) for k, n in EASTER_HOLIDAYS]
    fixed = [F.struct(F.make_date(y, F.lit(m), F.lit(d)).alias("date"), F.lit(n).alias("holiday_name"),
                      F.lit(False).alias("prayer")) for m, d, n in FIXED_HOLIDAYS]
    return years.select(y.alias("_y"), F.explode(F.array(*moving, *fixed)).alias("h")).where(
        ~F.col("h.prayer") | (F.col("_y") <= PRAYER_DAY_LAST_YEAR)).select("h.date", "h.holiday_name")


def years_of(df: DataFrame, date_col: str, before: int = 0, after: int = 0) -> DataFrame:
    """One row per calendar year between the first and the last date."""
    span = df.agg(F.year(F.min(date_col)).alias("a"), F.year(F.max(date_col)).alias("b"))
    return span.select(F.explode(F.sequence(F.col("a") - before, F.col("b") + after)).alias("year"))


def days_of(df: DataFrame, date_col: str) -> DataFrame:
    """One row per day between the first and the last date."""
    span = df.agg(F.min(date_col).alias("a"), F.max(date_col).alias("b"))
    return span.select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"), F.expr("interval 1 day"))).alias("date"))
