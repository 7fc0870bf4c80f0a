"""File-level sources and sinks: raw text scans, manifests, exports, prediction store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from larder.functions.exprs import finite

# fixed values: column names that hint at numbers and at epoch times, and bounds of a plausible epoch
NUMERIC_TOKENS = ["_id", "amount", "price", "quantity", "vat", "discount", "points", "cash", "cost", "value",
                  "commission", "redemptions", "orders", "cltv", "threshold", "number", "index", "variance",
                  "balance", "total", "opening", "closing", "expected", "actual", "tier", "service_charge",
                  "delivery_charge"]
NUMERIC_NAMES = {"id", "index", "number"}
DATETIME_NAMES = {"created", "updated", "start_time", "end_time", "start_date_time", "end_date_time", "promise_time",
                  "pickup_time", "report_date", "balance_date", "valid_from", "valid_to", "contract_start",
                  "termination_date"}
DATETIME_SUFFIXES = ("_time", "_date", "_datetime")
EPOCH_S, EPOCH_MS = (946684800, 4102444800), (946684800000, 4102444800000)
MIN_SHARE = 0.6


def raw_scan(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; splits take the place of hand-made chunks."""
    return spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False).csv(path)


def number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Parse share, maximum and share of plausible epochs of each column, in one pass."""
    n = F.count(F.lit(1))
    aggs = []
    for c in columns:
        x = number(c)
        aggs.append(F.struct(
            F.lit(c).alias("column"),
            F.try_divide(F.count(x), n).alias("numeric_share"), F.max(x).alias("max_value"),
            F.try_divide(F.count_if(x.between(*EPOCH_S)), F.count(x)).alias("s_share"),
            F.try_divide(F.count_if(x.between(*EPOCH_MS)), F.count(x)).alias("ms_share")).alias(f"p_{c}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"p_{c}") for c in columns])).alias("p")).select("p.*")


def epoch_unit() -> Column:
    """'s', 'ms' or 'none' for a profile row."""
    enough = F.col("numeric_share") >= MIN_SHARE
    return (F.when(enough & (F.col("max_value") > 1e12), F.when(F.col("ms_share") >= MIN_SHARE, "ms").otherwise("none"))
            .when(enough & (F.col("max_value") > 1e9) & (F.col("s_share") >= MIN_SHARE), "s").otherwise("none"))


def wants_number(name: str) -> bool:
    low = name.lower()
    return low in NUMERIC_NAMES or any(t in low for t in NUMERIC_TOKENS)


def wants_datetime(name: str) -> bool:
    low = name.lower().strip()
    return low in DATETIME_NAMES or low.endswith(DATETIME_SUFFIXES)


def infer_numeric(df: DataFrame) -> DataFrame:
    """Per column: name hint, parse share and whether it becomes numeric."""
    p = profile(df, df.columns)
    hinted = [c for c in df.columns if wants_number(c)]
    return p.select("column", F.col("column").isin(hinted).alias("hinted"), "numeric_share",
                    (F.col("column").isin(hinted) & (F.col("numeric_share") >= MIN_SHARE)).alias("is_numeric"))


def clean_raw(df: DataFrame) -> DataFrame:
    """Trim names and text, cast numeric columns, add ISO text for epoch columns.

    The profile has one row per column, so collecting it is bounded by the schema.
    """
    df = df.toDF(*[c.strip() for c in df.columns])
    df = df.select(*[F.trim(F.col(c)).alias(c) for c in df.columns])
    facts = {r["column"]: r for r in profile(df, df.columns).withColumn("unit", epoch_unit()).collect()}
    out = {}
    for c in df.columns:
        share = facts[c]["numeric_share"] or 0
        if wants_number(c) and share >= MIN_SHARE:
            out[c] = number(c)
        if wants_datetime(c) and facts[c]["unit"] != "none":
            secs = number(c) / (1000 if facts[c]["unit"] == "ms" else 1)
            ts = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))
            out[f"{c}_dt"] = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.withColumns(out) if out else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).csv(path)


def file_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Name, size and change time of each file; contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
                        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def dataset_inventory(spark: SparkSession, root: str, tables: dict[str, DataFrame], suffix: str) -> DataFrame:
    """Manifest with the column count of each table, largest first."""
    widths = F.create_map(*[F.lit(x) for n, df in tables.items() for x in (n, len(df.columns))])
    m = file_manifest(spark, root, f"*{suffix}")
    return m.withColumn("table_name", F.regexp_replace("file", suffix.replace(".", r"\.") + "$", "")).withColumn(
        "column_count", widths[F.col("table_name")]).orderBy(F.desc("bytes"), "file")


PREDICTION_COLUMNS = ["date", "place_id", "item_id", "quantity_sold", "predicted"]


def save_predictions(df: DataFrame, path: str) -> None:
    """One folder per place; rows of a place are spread over files by item, so no place is one task."""
    df.repartition("place_id", "item_id").write.mode("error").partitionBy("place_id").parquet(path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    missing = [c for c in PREDICTION_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"predictions lack columns {missing}")
    return df.withColumn("predicted", finite("predicted"))


def weather_dim(spark: SparkSession, path: str | None) -> DataFrame:
    """Daily weather from a file; no file gives a table without rows."""
    schema = T.StructType([T.StructField("date", T.DateType())] + [
        T.StructField(c, T.DoubleType()) for c in ("temperature_max", "temperature_min", "precipitation_mm")])
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def parse_datetime(df: DataFrame, column: str, out: str) -> DataFrame:
    """Timestamp of a text or epoch column, decided by one profile row of the whole column.

    Text if most values parse as a time; else milliseconds or seconds by the largest
    number if most values are numbers; else NULL.
    """
    text = F.col(column).cast("string").try_cast("timestamp_ntz")
    x = number(column)
    n = F.count(F.lit(1))
    unit = (F.when(F.try_divide(F.count(text), n) >= MIN_SHARE, "text").when(F.try_divide(F.count(x), n) < MIN_SHARE, "none")
            .when(F.max(x) > 1e12, "ms").otherwise("s"))
    mode = df.agg(unit.alias("m")).scalar()
    secs = F.when(mode == "ms", x / 1000).otherwise(x).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=secs)
    return df.withColumn(out, F.when(mode == "text", text).when(mode.isin("ms", "s"), epoch))


def split_ids(df: DataFrame, column: str, out: str) -> DataFrame:
    """One row per id of a pipe-separated list; empty parts are dropped."""
    ids = F.filter(F.split(column, r"\|"), lambda s: F.trim(s) != "")
    return df.withColumn(out, F.explode(ids)).withColumn(out, F.col(out).try_cast("long"))
