"""Per-day context: calendar, retail season, payday, holidays, weather, recommendation bias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from larder.functions.calendars import easter
from larder.functions.exprs import flag

# every window here runs over calendar days, a few hundred rows per year

# fixed values: weather codes and their text
WMO_TEXT = {
    0: "clear sky", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "fog", 48: "depositing rime fog",
    51: "light drizzle", 53: "moderate drizzle", 55: "dense drizzle", 61: "slight rain", 63: "moderate rain",
    65: "heavy rain", 66: "light freezing rain", 67: "heavy freezing rain", 71: "slight snow", 73: "moderate snow",
    75: "heavy snow", 77: "snow grains", 80: "slight rain showers", 81: "moderate rain showers",
    82: "violent rain showers", 85: "slight snow showers", 86: "heavy snow showers", 95: "thunderstorm",
    96: "thunderstorm with slight hail", 99: "thunderstorm with heavy hail",
}
RAINY_MM = 1.0  # fixed value


def date_of(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def calendar_signals(days: DataFrame) -> DataFrame:
    d = F.col("date")
    return days.withColumns({
        "day_of_week": F.date_format(d, "EEEE"), "day_of_week_num": F.weekday(d) + 1,
        "is_weekend": F.weekday(d) >= 5, "is_friday": F.weekday(d) == 4, "is_monday": F.weekday(d) == 0,
        "week_number": F.weekofyear(d), "month": F.month(d), "day_of_month": F.day(d),
        "is_month_start": F.day(d) <= 3, "is_month_end": F.datediff(F.last_day(d), d) <= 2})


def retail_signals(days: DataFrame) -> DataFrame:
    """Danish retail events and seasons of each day."""
    d = F.col("date")
    y, m, dom, week = F.year(d), F.month(d), F.day(d), F.weekofyear(d)
    sunday = easter(y)
    nov1 = date_of(y, 11, 1)
    j_dag = F.date_add(nov1, F.pmod(F.lit(4) - F.weekday(nov1), F.lit(7)))
    to_xmas = F.datediff(date_of(y, 12, 24), d)
    school = (
        week.isin(42, 7, 8)
        | ((m == 12) & (dom >= 23)) | ((m == 1) & (dom <= 4))
        | d.between(F.date_sub(sunday, 3), F.date_add(sunday, 5))
        | (m == 7) | ((m == 6) & (dom >= 28)) | ((m == 8) & (dom <= 10)))
    season = F.element_at(F.array(*[F.lit(s) for s in ("winter", "spring", "summer", "autumn")]),
                          (F.floor(m % 12 / 3) + 1).cast("int"))
    return days.withColumns({
        "is_fastelavn": d == F.date_sub(sunday, 49), "is_sankt_hans": (m == 6) & (dom == 23), "is_j_dag": d == j_dag,
        "is_julefrokost_season": m.isin(11, 12) & (dom <= 23), "is_christmas_season": (m == 12) & (dom <= 24),
        "days_to_christmas": F.when(to_xmas >= 0, to_xmas).otherwise(F.datediff(date_of(y + 1, 12, 24), d)),
        "is_new_years_eve": (m == 12) & (dom == 31), "is_grilling_season": m.between(5, 8),
        "is_school_holiday": school,
        "is_black_friday": (m == 11) & (F.weekday(d) == 4) & dom.between(22, 28), "season": season})


def payday_signals(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Business day, and distance to the paydays around: the last business day of each month."""
    span = days.agg(F.add_months(F.trunc(F.min("date"), "month"), -1).alias("a"),
                    F.last_day(F.add_months(F.max("date"), 1)).alias("b"))
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    free = holidays.select("date").distinct()
    working = every.where(F.weekday("date") < 5).join(free, "date", "left_anti")
    pay = working.groupBy(F.trunc("date", "month").alias("_m")).agg(F.max("date").alias("_pay"))
    prev = pay.select(F.add_months("_m", 1).alias("_m"), F.col("_pay").alias("_prev"))
    nxt = pay.select(F.add_months("_m", -1).alias("_m"), F.col("_pay").alias("_next"))
    holiday = free.withColumn("_hol", F.lit(True))
    j = days.withColumn("_m", F.trunc("date", "month")).join(pay, "_m").join(prev, "_m").join(nxt, "_m").join(holiday, "date", "left")
    before = F.col("date") <= F.col("_pay")
    out = j.withColumns({
        "is_business_day": (F.weekday("date") < 5) & F.col("_hol").isNull(),
        "days_since_payday": F.datediff("date", F.when(before, F.col("_prev")).otherwise(F.col("_pay"))),
        "days_to_payday": F.datediff(F.when(before, F.col("_pay")).otherwise(F.col("_next")), F.col("date"))})
    return out.withColumn("is_payday_week", (F.col("days_to_payday") <= 2) | (F.col("days_since_payday") <= 2)).drop(
        "_m", "_pay", "_prev", "_next", "_hol")


def long_weekends(days: DataFrame, holidays: DataFrame, min_days: int = 3) -> DataFrame:
    """Runs of at least three free days (weekend or holiday) as (start, end)."""
    span = days.agg(F.date_sub(F.min("date"), 10).alias("a"), F.date_add(F.max("date"), 10).alias("b"))
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    hol = holidays.select("date").distinct().withColumn("_h", F.lit(True))
    free = every.join(hol, "date", "left").where((F.weekday("date") >= 5) | F.col("_h"))
    run = free.withColumn("_run", F.date_sub("date", F.row_number().over(Window.orderBy("date"))))
    return run.groupBy("_run").agg(F.min("date").alias("start"), F.max("date").alias("end")).where(
        F.datediff("end", "start") + 1 >= min_days).drop("_run")


def holiday_signals(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """On, before and after a holiday, the next one and its distance, long weekends now or within 3 days."""
    from larder.operators.joins import holiday_flags
    flags = holiday_flags(days, holidays)
    h = holidays.groupBy("date").agg(F.max("holiday_name").alias("_name"))
    both = days.select("date", F.lit(None).cast("string").alias("_name"), F.lit(True).alias("_day")).unionByName(
        h.withColumn("_day", F.lit(False)))
    nxt = both.withColumn("_d", F.unix_date("date")).withColumn(
        "_n", F.first(F.when(~F.col("_day"), F.struct("date", "_name")), ignorenulls=True).over(
            Window.orderBy("_d").rangeBetween(1, Window.unboundedFollowing))).where("_day")
    nxt = nxt.select("date", F.col("_n._name").alias("next_holiday"), F.datediff("_n.date", "date").alias("days_to_next_holiday"))
    runs = long_weekends(days, holidays)
    inside = runs.select(F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("date"), F.lit(True).alias("is_long_weekend"))
    ahead = runs.select(F.explode(F.sequence(F.date_sub("start", 3), F.date_sub("start", 1), F.expr("interval 1 day"))).alias("date")).distinct().withColumn(
        "long_weekend_approaching", F.lit(True))
    return flags.join(nxt, "date", "left").join(inside, "date", "left").join(ahead, "date", "left").withColumns({
        "is_long_weekend": F.coalesce("is_long_weekend", F.lit(False)),
        "long_weekend_approaching": F.coalesce("long_weekend_approaching", F.lit(False))})


def weather_features(weather: DataFrame) -> DataFrame:
    text = F.create_map(*[F.lit(x) for kv in WMO_TEXT.items() for x in kv])
    code = F.col("weather_code").cast("int")
    return weather.withColumns({
        "is_rainy": flag(F.col("precipitation_mm") > RAINY_MM),
        "weather_description": F.when(code.isNull(), "unknown").otherwise(
            F.coalesce(F.try_element_at(text, code), F.concat(F.lit("code_"), code.cast("string")))),
        "sunshine_hours": F.round(F.coalesce("sunshine_s", F.lit(0)) / 3600, 1)})


def _reasons(parts: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Number of conditions that hold, and their texts joined in order."""
    n = sum((flag(c) for c, _ in parts), F.lit(0))
    return n, F.concat_ws("; ", *[F.when(c, t) for c, t in parts])


def signal_bias(df: DataFrame) -> DataFrame:
    """Counts of stock-out and waste signals, the resulting bias and its reasons."""
    b = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    rain, warm = F.col("precip_probability"), F.col("temperature_max")
    stock = [
        (b("is_friday") | b("is_weekend"), F.lit("weekend/Friday = higher foot traffic")),
        (b("is_day_before_holiday") | b("long_weekend_approaching"), F.lit("pre-holiday/long-weekend shopping surge")),
        (F.coalesce(warm > 22, F.lit(False)), F.concat(F.lit("warm ("), warm.cast("string"), F.lit("C) = more outdoor activity, beverage demand"))),
        (b("is_payday_week"), F.lit("payday week = higher discretionary spending")),
        (b("is_grilling_season"), F.lit("grilling season = outdoor food demand")),
        (b("is_julefrokost_season"), F.lit("Julefrokost season = office party supplies")),
        (b("is_christmas_season"), F.lit("Christmas season = elevated demand")),
        (b("is_school_holiday"), F.lit("school holiday = families at home, snack demand"))]
    waste = [
        (b("is_monday"), F.lit("Monday = historically lowest demand day")),
        (b("is_holiday"), F.lit("holiday = stores may be closed or low traffic")),
        (b("is_day_after_holiday"), F.lit("post-holiday = demand dip")),
        (F.coalesce(rain > 60, F.lit(False)), F.concat(F.lit("rain likely ("), rain.cast("string"), F.lit("%) = less foot traffic"))),
        (b("severe_weather"), F.lit("active severe weather warning"))]
    ns, ts = _reasons(stock)
    nw, tw = _reasons(waste)
    score = ns - nw
    text = F.concat_ws(" | ", F.when(ns > 0, F.concat(F.lit("Stockout risks: "), ts)), F.when(nw > 0, F.concat(F.lit("Waste risks: "), tw)))
    return df.withColumns({
        "stockout_signals": ns, "waste_signals": nw,
        "bias": F.when(score >= 2, "stockout_reduce").when(score <= -1, "waste_reduce").otherwise("neutral"),
        "reasoning": F.when(text == "", "No strong signals either way.").otherwise(text)})


CALENDAR = ["day_of_week", "day_of_week_num", "is_weekend", "is_friday", "is_monday", "week_number", "month",
            "day_of_month", "is_month_start", "is_month_end"]
RETAIL = ["is_fastelavn", "is_sankt_hans", "is_j_dag", "is_julefrokost_season", "is_christmas_season", "days_to_christmas",
          "is_new_years_eve", "is_grilling_season", "is_school_holiday", "is_black_friday", "season"]
HOLIDAY = ["is_holiday", "holiday_name", "is_day_before_holiday", "is_day_after_holiday", "next_holiday",
           "days_to_next_holiday", "is_long_weekend", "long_weekend_approaching"]
BUSINESS = ["is_business_day", "days_since_payday", "days_to_payday", "is_payday_week"]
WEATHER = ["temperature_max", "temperature_min", "precipitation_mm", "precip_probability", "is_rainy",
           "weather_description", "sunshine_hours", "severe_weather"]
BIAS = ["bias", "reasoning", "stockout_signals", "waste_signals"]


def context_signals(days: DataFrame, holidays: DataFrame, weather: DataFrame) -> DataFrame:
    """One nested record per day: calendar, retail, holidays, business, weather and bias structs."""
    df = retail_signals(calendar_signals(days)).join(holiday_signals(days, holidays), "date").join(
        payday_signals(days, holidays), "date").join(weather_features(weather), "date", "left")
    df = signal_bias(df)
    groups = {"calendar": CALENDAR, "retail": RETAIL, "holidays": HOLIDAY, "business": BUSINESS, "weather": WEATHER, "recommendation_bias": BIAS}
    return df.select("date", *[F.struct(*cols).alias(name) for name, cols in groups.items()])


def opening_flag(df: DataFrame, places: DataFrame, date_col: str = "date") -> DataFrame:
    """1 unless the place's opening hours name the weekday as closed; unreadable hours count as open."""
    hours = F.from_json("opening_hours", "map<string, struct<`from`: string, `to`: string>>")
    p = places.select("place_id", hours.alias("_h"))
    day = F.lower(F.date_format(date_col, "EEEE"))
    start = F.try_element_at(F.col("_h"), day)["from"]
    return df.join(p, "place_id", "left").withColumn(
        "is_open", F.when(start == "closed", 0).otherwise(1)).drop("_h")
