"""Table catalog: declared schemas, typed loads, views and the read-only SQL guard."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larder.operators.cleaning import coerce_schema

L, D, S = T.LongType(), T.DoubleType(), T.StringType()


def struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


@dataclass(frozen=True)
class TableSpec:
    """Where a logical table lies, its declared columns and its epoch columns."""

    path: str
    schema: T.StructType
    timestamps: tuple[str, ...] = ()
    timezone: str = "Europe/Copenhagen"
    id_columns: tuple[str, ...] = field(default_factory=tuple)


# declared schemas of the retail tables
SCHEMAS: dict[str, T.StructType] = {
    "fct_orders": struct(id=L, user_id=L, created=L, updated=L, cash_amount=D, demo_mode=L, discount_amount=D,
                         items_amount=D, place_id=L, total_amount=D, vat_amount=D, status=S, type=S, channel=S,
                         source=S, payment_method=S),
    "fct_order_items": struct(id=L, user_id=L, created=L, updated=L, title=S, cost=D, discount_amount=D, item_id=L,
                              order_id=L, price=D, quantity=L, status=S, vat_amount=D, campaign_id=L,
                              commission_amount=D),
    "dim_items": struct(id=L, user_id=L, created=L, updated=L, title=S, description=S, price=D, status=S, type=S,
                        section_id=L, vat=D, deleted=L, demo_mode=L),
    "dim_places": struct(id=L, user_id=L, created=L, updated=L, title=S, country=S, currency=S, timezone=S,
                         latitude=D, longitude=D, opening_hours=S, street_address=S),
    "fct_campaigns": struct(id=L, user_id=L, created=L, updated=L, title=S, discount=D, discount_type=S,
                            start_date_time=L, end_date_time=L, place_id=L, status=S, type=S, item_ids=S,
                            redemptions=L, used_redemptions=L),
    "most_ordered": struct(place_id=L, item_id=L, item_name=S, order_count=L),
    "dim_skus": struct(id=L, user_id=L, created=L, updated=L, stock_category_id=L, item_id=L, title=S, quantity=D,
                       low_stock_threshold=D, type=S, unit=S),
    "dim_bill_of_materials": struct(parent_sku_id=L, sku_id=L, quantity=D),
    "dim_stock_categories": struct(id=L, title=S),
    "weather": struct(date=T.DateType(), temperature_max=D, temperature_min=D, precipitation_mm=D, is_rainy=L),
    "holidays": struct(date=T.DateType(), holiday_name=S),
}


def default_catalog(root: str) -> dict[str, TableSpec]:
    stamped = {n for n, s in SCHEMAS.items() if "created" in s.names}
    out = {}
    for name, schema in SCHEMAS.items():
        ts = ("created", "updated") if name in stamped else ()
        if name == "fct_campaigns":
            ts += ("start_date_time", "end_date_time")
        out[name] = TableSpec(f"{root}/{name}.csv", schema, ts, id_columns=("id",) if "id" in schema.names else ())
    return out


def resolve(catalog: dict[str, TableSpec], name: str) -> TableSpec:
    """Spec of a known table; unknown names and upward paths are refused."""
    if name not in catalog:
        raise KeyError(f"unknown table {name!r}")
    spec = catalog[name]
    if ".." in spec.path.split("/"):
        raise ValueError(f"path of table {name!r} leaves its folder")
    return spec


def epoch_to_utc(c: str | F.Column) -> F.Column:
    """Epoch seconds as a zoneless UTC timestamp; non-positive and non-numeric values become NULL.

    Built from interval arithmetic, so the session time zone plays no part.
    """
    x = F.col(c) if isinstance(c, str) else c
    good = F.when(x > 0, x)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=good.cast("decimal(18,6)"))


def convert_unix_timestamps(df: DataFrame, columns: list[str], tz: str) -> DataFrame:
    """Add ``<col>_dt``: local wall-clock time of each epoch column."""
    return df.withColumns({
        f"{c}_dt": F.convert_timezone(F.lit("UTC"), F.lit(tz), epoch_to_utc(c)) for c in columns})


def load_table(spark: SparkSession, catalog: dict[str, TableSpec], name: str) -> DataFrame:
    """Scan, coerce to the declared types and add local timestamps."""
    spec = resolve(catalog, name)
    if spec.path.endswith(".csv"):
        raw = spark.read.option("header", True).csv(spec.path)
    else:
        raw = spark.read.parquet(spec.path)
    df = coerce_schema(raw, spec.schema)
    return convert_unix_timestamps(df, [c for c in spec.timestamps if c in df.columns], spec.timezone)


def load_all_tables(spark: SparkSession, catalog: dict[str, TableSpec],
                    names: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables that load, and the error text of those that do not."""
    tables, errors = {}, {}
    for name in names or catalog:
        try:
            tables[name] = load_table(spark, catalog, name)
        except Exception as e:  # noqa: BLE001 - a broken table must not stop the others
            errors[name] = str(e)
    return tables, errors


def load_csv(spark: SparkSession, path: str, parse_dates: list[str] = ()) -> DataFrame:
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in parse_dates}) if parse_dates else df


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_directory(spark: SparkSession, root: str, names: list[str], fmt: str = "csv") -> None:
    """Each file of a folder becomes a SQL view."""
    for name in names:
        reader = spark.read
        if fmt == "csv":
            reader = reader.option("header", True).option("inferSchema", True)
        reader.format(fmt).load(f"{root}/{name}.{fmt}").createOrReplaceTempView(name)


_READ_ONLY = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)
#: Nodes of a parsed plan that change something.
_WRITES = re.compile(r"^[\s:+|-]*'?(Insert|Create|Replace|Drop|Truncate|Delete|Update|Merge|Alter|Overwrite|Append|Load|Set|Cache|Uncache|Refresh|\w+Command)\w*\b", re.MULTILINE)


#: Strings, quoted names' quotes and comments, none of which can call a function.
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|--[^\n]*|/\*.*?\*/""", re.DOTALL)
#: Functions that run any method of the JVM, and names built from text.
_CALLS = re.compile(r"\b(reflect|try_reflect|java_method|identifier)`?\s*\(", re.IGNORECASE)
_RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")
_TABLE_FUNCTION = re.compile(r"UnresolvedTableValuedFunction \[([^\]]*)\]")
_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}


def adhoc_sql(spark: SparkSession, sql: str, cap: int = 100) -> DataFrame:
    """Run a SELECT or WITH statement, capped; everything else is refused before it runs.

    The keyword test comes first. Then the parsed statement is searched for writes and commands, which can follow a
    WITH; parsing neither resolves nor runs it. Functions that run JVM methods, files named as tables and table functions
    other than the plain generators are refused: of relations, one name is allowed, or a qualified name the catalog knows.
    """
    if not _READ_ONLY.match(sql):
        raise ValueError("only SELECT and WITH statements are allowed")
    if _CALLS.search(_QUOTED.sub(lambda m: " " if m[0][0] in "-/" else "''", sql)):
        raise ValueError("the statement calls a function that is not allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()
    if _WRITES.search(plan):
        raise ValueError("the statement writes or is a command")
    if any(f.strip().lower() not in _TABLE_FUNCTIONS for f in _TABLE_FUNCTION.findall(plan)):
        raise ValueError("the statement reads from a table function that is not allowed")
    for name in _RELATION.findall(plan):
        parts = [p.strip() for p in name.split(",")]
        if len(parts) > 1 and ("/" in name or not spark.catalog.tableExists(".".join(f"`{p}`" for p in parts))):
            raise ValueError("the statement reads a table the catalog does not hold")
    return spark.sql(sql).limit(cap)


def table_info(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and column description per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"),
            F.lit(",".join(df.columns)).alias("columns"))
        for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def json_records(df: DataFrame, out: str = "record") -> DataFrame:
    """Rows as JSON text; NaN becomes null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        cols.append(F.nanvl(c, F.lit(None).cast("double")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(out))
