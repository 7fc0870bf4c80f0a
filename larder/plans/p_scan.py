"""Scans, sources, sinks, cleaning and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from larder.functions import calendars
from larder.functions.exprs import rnd
from larder.operators import cleaning, demand
from larder.plans import frames
from larder.plans.registry import query
from larder.plans.sqlbase import Q, S
from larder.session import scratch_path
from larder.sources import bindings, catalog, files

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

ORDERS_SPEC = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("created", T.LongType())])


def _epochs(spark, sf):
    """Orders with a creation epoch inside the order day, as the raw feed has it."""
    o = bindings.read(spark, sf, "orders")
    secs = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400 + (F.col("o_orderkey") * 7919) % 86400
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                    F.when(F.col("o_orderpriority") == "5-LOW", -1).otherwise(secs).alias("created"))


_EPOCH_SQL = """e AS (SELECT *, CASE WHEN o_orderpriority = '5-LOW' THEN -1
  ELSE CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + (o_orderkey * 7919) % 86400 END AS created FROM orders)"""
_LOCAL = "CASE WHEN created > 0 THEN (to_timestamp(created) AT TIME ZONE 'Europe/Copenhagen') END"


@query("scan_typed", Q("", _EPOCH_SQL, f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, created,
  strftime({_LOCAL}, '%Y-%m-%d %H:%M:%S') AS created_dt FROM e"""))
def _(spark, sf):
    typed = cleaning.coerce_schema(_epochs(spark, sf), ORDERS_SPEC)
    out = catalog.convert_unix_timestamps(typed, ["created"], "Europe/Copenhagen")
    return out.withColumn("created_dt", F.date_format("created_dt", "yyyy-MM-dd HH:mm:ss"))


@query("unix_to_local", Q("", _EPOCH_SQL, f"""SELECT CAST({_LOCAL} AS DATE) AS local_date, COUNT(*) AS n,
  {S('o_totalprice', 2)} AS total FROM e GROUP BY 1"""))
def _(spark, sf):
    local = catalog.convert_unix_timestamps(_epochs(spark, sf), ["created"], "Europe/Copenhagen")
    from larder.functions.exprs import exact_sum
    return local.groupBy(F.to_date("created_dt").alias("local_date")).agg(
        F.count(F.lit(1)).alias("n"), exact_sum("o_totalprice", 2).alias("total"))


@query("raw_to_clean")
def _(spark, sf):
    e = bindings.read(spark, sf, "events")
    raw = e.select(F.concat(F.lit(" "), F.col("event_id").cast("string")).alias(" event_id "),
                   F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("created"),
                   F.concat(F.col("event_type"), F.lit("  ")).alias("kind"),
                   F.col("value").cast("string").alias("value"))
    src, out = scratch_path(spark, "raw"), scratch_path(spark, "clean")
    files.write_csv(raw, src)
    files.write_csv(files.clean_raw(files.raw_scan(spark, src)), out)
    return files.raw_scan(spark, out)


@query("file_manifest")
def _(spark, sf):
    return files.file_manifest(spark, sf, "*.parquet").withColumn("modified", F.col("modified").cast("string"))


@query("dataset_inventory")
def _(spark, sf):
    return files.dataset_inventory(spark, sf, {n: bindings.read(spark, sf, n) for n in TABLES}, ".parquet").drop("modified")


_OUDIN = """ys AS (SELECT CAST(y AS BIGINT) AS y FROM (SELECT MIN(YEAR(o_orderdate)) AS a, MAX(YEAR(o_orderdate)) AS b FROM orders), range(a, b + 1) AS t(y)),
p1 AS (SELECT y, y % 19 AS g, y // 100 AS c FROM ys),
p2 AS (SELECT *, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM p1),
p3 AS (SELECT *, h - (h // 28) * (1 - (h // 28) * (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM p2),
p4 AS (SELECT *, i - (y + y // 4 + i + 2 - c + c // 4) % 7 AS l FROM p3),
eas AS (SELECT y, make_date(y, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) AS e FROM p4),
hol AS (SELECT e + k AS date, n AS holiday_name FROM eas, (VALUES (-3, 'Skærtorsdag'), (-2, 'Langfredag'), (0, 'Påskedag'),
  (1, 'Anden påskedag'), (26, 'Store bededag'), (39, 'Kristi himmelfartsdag'), (49, 'Pinsedag'), (50, 'Anden pinsedag')) AS v(k, n)
  WHERE n <> 'Store bededag' OR y <= 2023
  UNION ALL SELECT make_date(y, m, d), n FROM eas, (VALUES (1, 1, 'Nytårsdag'), (12, 25, 'Juledag'), (12, 26, 'Anden juledag')) AS v(m, d, n))"""


@query("holiday_dim", Q("", _OUDIN, "SELECT CAST(date AS DATE) AS date, holiday_name FROM hol"))
def _(spark, sf):
    return calendars.holidays(calendars.years_of(bindings.read(spark, sf, "orders"), "o_orderdate"))


@query("table_info", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM {t}) AS row_count, COUNT(*) AS column_count, "
    f"STRING_AGG(column_name, ',' ORDER BY column_index) AS columns FROM duckdb_columns() WHERE table_name = '{t}'"
    for t in TABLES))
def _(spark, sf):
    return catalog.table_info({n: bindings.read(spark, sf, n) for n in TABLES})


@query("json_records", """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","value":' ||
  CASE WHEN event_type = 'error' THEN 'null' ELSE CAST(value AS VARCHAR) END || '}' AS record FROM events""")
def _(spark, sf):
    e = bindings.read(spark, sf, "events")
    bad = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return catalog.json_records(e.select("event_id", "event_type", bad.alias("value")))


@query("adhoc_sql", "SELECT n_name, COUNT(*) AS customers, MAX(c_acctbal) AS top_balance FROM customer JOIN nation "
       "ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name LIMIT 100")
def _(spark, sf):
    catalog.register_views(spark, {n: bindings.read(spark, sf, n) for n in ("customer", "nation")})
    return catalog.adhoc_sql(spark, "SELECT n_name, COUNT(*) AS customers, MAX(c_acctbal) AS top_balance FROM customer "
                             "JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name")


# ---- cleaning ----------------------------------------------------------------------

@query("coerce_schema", """WITH raw AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'nan' WHEN 'signup' THEN 'n/a'
  ELSE CAST(CAST(FLOOR(value) AS BIGINT) AS VARCHAR) END AS value, CASE WHEN event_type = 'view' THEN event_type
  ELSE regexp_extract(props, '([0-9]+)', 1) END AS k FROM events)
SELECT event_id, TRY_CAST(NULLIF(value, 'nan') AS DOUBLE) AS value, TRY_CAST(NULLIF(k, 'nan') AS BIGINT) AS k FROM raw""")
def _(spark, sf):
    e = bindings.read(spark, sf, "events")
    t = F.col("event_type")
    raw = e.select("event_id",
                   F.when(t == "error", "nan").when(t == "signup", "n/a")
                   .otherwise(F.floor("value").cast("string")).alias("value"),
                   F.when(t == "view", t).otherwise(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"))
    return cleaning.coerce_schema(raw, T.StructType([
        T.StructField("value", T.DoubleType()), T.StructField("k", T.LongType())]))


@query("dq_report", """SELECT COUNT(*) AS row_count, COUNT(*) FILTER (user_id IS NULL) * 100.0::DOUBLE / COUNT(*) AS user_id_null_pct,
  COUNT(*) FILTER (event_id IS NULL) * 100.0::DOUBLE / COUNT(*) AS event_id_null_pct, 'created,place_id' AS missing_columns
FROM (SELECT event_id, NULLIF(user_id, 8) AS user_id FROM events)""")
def _(spark, sf):
    e = bindings.read(spark, sf, "events").withColumn("user_id", F.nullif(F.col("user_id"), F.lit(8)))
    return cleaning.dq_report(e, ["event_id", "created", "place_id"], ["user_id", "event_id"])


def _raw_columns(spark, sf):
    return bindings.read(spark, sf, "events").select(
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("created"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("updated"),
        F.when(F.col("event_type") == "error", "x").otherwise(F.col("event_id").cast("string")).alias("event_id"),
        F.col("event_type").alias("status"), F.col("user_id").cast("string").alias("who"),
        F.when(F.col("event_type").isin("click", "view"), F.col("user_id").cast("string")).otherwise("-").alias("total_amount"))


_RAW_SQL = """raw AS (SELECT CAST(epoch_ms(ts) AS VARCHAR) AS created, CAST(CAST(FLOOR(epoch(ts)) AS BIGINT) AS VARCHAR) AS updated,
  CASE WHEN event_type = 'error' THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS event_id, event_type AS status,
  CAST(user_id AS VARCHAR) AS who, CASE WHEN event_type IN ('click', 'view') THEN CAST(user_id AS VARCHAR) ELSE '-' END AS total_amount FROM events)""", \
    """long AS (UNPIVOT raw ON created, updated, event_id, status, who, total_amount INTO NAME "column" VALUE v)""", \
    """prof AS (SELECT "column", COUNT(TRY_CAST(v AS DOUBLE)) / COUNT(*) AS numeric_share, MAX(TRY_CAST(v AS DOUBLE)) AS mx,
  COUNT(*) FILTER (TRY_CAST(v AS DOUBLE) BETWEEN 946684800 AND 4102444800) / NULLIF(COUNT(TRY_CAST(v AS DOUBLE)), 0) AS ss,
  COUNT(*) FILTER (TRY_CAST(v AS DOUBLE) BETWEEN 946684800000 AND 4102444800000) / NULLIF(COUNT(TRY_CAST(v AS DOUBLE)), 0) AS ms
FROM long GROUP BY "column")"""


@query("epoch_profile", Q("", *_RAW_SQL, """SELECT "column", numeric_share, mx AS max_value,
  CASE WHEN numeric_share >= 0.6 AND mx > 1e12 THEN CASE WHEN ms >= 0.6 THEN 'ms' ELSE 'none' END
  WHEN numeric_share >= 0.6 AND mx > 1e9 AND ss >= 0.6 THEN 's' ELSE 'none' END AS unit FROM prof"""))
def _(spark, sf):
    raw = _raw_columns(spark, sf)
    return files.profile(raw, raw.columns).select("column", "numeric_share", "max_value", files.epoch_unit().alias("unit"))


@query("infer_numeric", Q("", *_RAW_SQL, """SELECT "column", "column" IN ('event_id', 'total_amount') AS hinted, numeric_share,
  "column" IN ('event_id', 'total_amount') AND numeric_share >= 0.6 AS is_numeric FROM prof"""))
def _(spark, sf):
    return files.infer_numeric(_raw_columns(spark, sf))


@query("clean_orders", """SELECT o_orderkey AS id, o_custkey AS user_id, CAST(n_regionkey AS BIGINT) AS place_id,
  CAST(o_orderdate AS DATE) AS created_dt, o_orderpriority AS channel, o_totalprice AS total_amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND (o_orderpriority <> '5-LOW' OR o_orderkey % 7 = 0) AND n_regionkey <> 3""")
def _(spark, sf):
    o = bindings.fct_orders(spark, sf)
    demo = F.when(F.col("channel") == "5-LOW", F.when(F.col("id") % 7 == 0, None).otherwise(1)).otherwise(0)
    o = o.withColumn("demo", demo).withColumn("place_id", F.nullif(F.col("place_id"), F.lit(3)))
    out = cleaning.clean_orders(o.unionByName(o.where(F.col("channel") == "1-URGENT")), demo_col="demo")
    return out.select("id", "user_id", "place_id", F.to_date("created_dt").alias("created_dt"), "channel", "total_amount")


@query("clean_order_items", """SELECT order_id, line_no, item_id, quantity, cost FROM (SELECT l_orderkey AS order_id,
  l_linenumber AS line_no, NULLIF(p_type, 'LARGE') AS item_id, l_quantity - 5 AS quantity, l_extendedprice AS cost,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, p_type, l_quantity) AS rn
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'LARGE') WHERE rn = 1 AND quantity > 0""")
def _(spark, sf):
    l = bindings.fct_order_items(spark, sf).select(
        "order_id", "line_no", "cost", F.nullif(F.col("item_id"), F.lit("LARGE")).alias("item_id"),
        (F.col("quantity") - 5).alias("quantity"))
    return cleaning.clean_order_items(l, key=["order_id", "line_no"])


@query("clean_items", """SELECT p_partkey AS id, p_name AS title, p_retailprice AS price FROM part
WHERE p_size % 10 <> 0 AND p_brand <> 'Brand#3'""")
def _(spark, sf):
    p = bindings.read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"),
        F.when(F.col("p_size") % 10 == 0, 1).alias("deleted"),
        F.when(F.col("p_brand") == "Brand#3", 1).otherwise(0).alias("demo_mode"))
    return cleaning.clean_items(p.unionByName(p)).select("id", "title", "price")


@query("dedup_first", """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_quantity FROM (SELECT *, CAST(l_shipdate AS DATE) AS sd,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_quantity) AS rn
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate, l_partkey, l_quantity FROM lineitem)) WHERE rn = 1""")
def _(spark, sf):
    l = bindings.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("l_shipdate"), "l_partkey", "l_quantity")
    return cleaning.dedup_first(l, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate")])


@query("main_stores", Q("", """big AS (SELECT c_nationkey AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING COUNT(*) >= 600)""",
       """SELECT CAST(c_nationkey AS BIGINT) AS place_id, COUNT(DISTINCT o_orderkey) AS orders, COUNT(*) AS order_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT k FROM big) GROUP BY 1"""))
def _(spark, sf):
    o, l = bindings.fct_orders(spark, sf, "nation"), bindings.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    orders, lines = cleaning.main_stores(o, l, 600)
    return lines.join(orders.select(F.col("id").alias("order_id"), "place_id"), "order_id").groupBy("place_id").agg(
        F.countDistinct("order_id").alias("orders"), F.count(F.lit(1)).alias("order_lines"))


@query("apply_filters", Q("daily", "SELECT * FROM daily WHERE place_id IN (0, 2) AND item_id IN ('PROMO', 'SMALL') "
       "AND date >= DATE '1996-01-01' AND date <= DATE '1998-12-31'"))
def _(spark, sf):
    return cleaning.apply_filters(frames.daily(spark, sf), [0, 2], ["PROMO", "SMALL"], "1996-01-01", "1998-12-31")


@query("filter_options", Q("daily", """SELECT 'store' AS kind, CAST(place_id AS VARCHAR) AS value FROM daily GROUP BY place_id
UNION ALL SELECT 'item', item_id FROM (SELECT item_id, SUM(quantity_sold) AS q FROM daily WHERE place_id IN (1, 4) GROUP BY item_id ORDER BY q DESC, item_id LIMIT 4)
UNION ALL SELECT 'min_date', CAST(MIN(date) AS VARCHAR) FROM daily UNION ALL SELECT 'max_date', CAST(MAX(date) AS VARCHAR) FROM daily"""))
def _(spark, sf):
    d = frames.daily(spark, sf)
    top = cleaning.apply_filters(d, places=[1, 4]).groupBy("item_id").agg(F.sum("quantity_sold").alias("q")).orderBy(
        F.desc("q"), "item_id").limit(4)
    pair = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
    span = d.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return (pair(d.select("place_id").distinct(), "store", "place_id").unionByName(pair(top, "item", "item_id"))
            .unionByName(pair(span, "min_date", "lo")).unionByName(pair(span, "max_date", "hi")))


@query("sanitize", """SELECT event_id, CASE WHEN event_type IN ('error', 'signup', 'view') THEN 0 ELSE value END AS value,
  GREATEST(value - 20, 0) AS price FROM events""")
def _(spark, sf):
    t = F.col("event_type")
    e = bindings.read(spark, sf, "events").select(
        "event_id",
        F.when(t == "error", float("nan")).when(t == "signup", float("-inf")).when(t == "view", None)
        .otherwise(F.col("value")).alias("value"), (F.col("value") - 20).alias("price"))
    return cleaning.sanitize(e, ["value"], ["price"])


@query("orders_page", """WITH hit AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '2000-01-01')
SELECT *, (SELECT COUNT(*) FROM hit) AS total_count FROM hit ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100""")
def _(spark, sf):
    o = bindings.read(spark, sf, "orders")
    hit = o.where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
                  & (F.col("o_orderdate") >= F.lit("1997-01-01")) & (F.col("o_orderdate") < F.lit("2000-01-01"))).select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")
    return cleaning.page_with_total(hit, [F.desc("o_orderdate"), F.desc("o_orderkey")], 50, 100)


@query("page_with_total", """WITH hit AS (SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size <= 20)
SELECT *, (SELECT COUNT(*) FROM hit) AS total_count FROM hit ORDER BY p_name, p_partkey LIMIT 25 OFFSET 25""")
def _(spark, sf):
    hit = bindings.read(spark, sf, "part").where(F.col("p_size") <= 20).select("p_partkey", "p_name", "p_retailprice")
    return cleaning.page_with_total(hit, [F.asc("p_name"), F.asc("p_partkey")], 25, 25)


@query("search_any", "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%RED%' OR p_type ILIKE '%RED%'")
def _(spark, sf):
    return cleaning.search_any(bindings.read(spark, sf, "part"), "RED", ["p_name", "p_brand", "p_type"]).select(
        "p_partkey", "p_name", "p_brand", "p_type")


@query("parse_datetime", """SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS from_text,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_s, NULL::VARCHAR AS from_noise FROM events""")
def _(spark, sf):
    df = bindings.read(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("text"),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("ms"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("s"), F.col("event_type").alias("noise"))
    for c in ("text", "ms", "s", "noise"):
        df = files.parse_datetime(df, c, f"from_{c}")
    return df.select("event_id", *[F.date_format(f"from_{c}", "yyyy-MM-dd HH:mm:ss").alias(f"from_{c}") for c in ("text", "ms", "s", "noise")])


@query("split_ids", """SELECT o_custkey, TRY_CAST(TRIM(x) AS BIGINT) AS item_id FROM (SELECT o_custkey, UNNEST(string_split(ids, '|')) AS x FROM
  (SELECT o_custkey, CAST(MIN(o_orderkey) AS VARCHAR) || '||' || MAX(o_orderkey) || '|' || CASE WHEN o_custkey % 3 = 0 THEN 'x' ELSE '' END AS ids FROM orders GROUP BY o_custkey)) WHERE TRIM(x) <> ''""")
def _(spark, sf):
    o = bindings.read(spark, sf, "orders").groupBy("o_custkey").agg(F.concat(
        F.min("o_orderkey").cast("string"), F.lit("||"), F.max("o_orderkey").cast("string"), F.lit("|")).alias("head"))
    ids = F.concat("head", F.when(F.col("o_custkey") % 3 == 0, "x").otherwise(""))
    return files.split_ids(o.select("o_custkey", ids.alias("ids")), "ids", "item_id").select("o_custkey", "item_id")


# ---- row filters and lookups -----------------------------------------------------------

@query("date_range", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'""")
def _(spark, sf):
    o = bindings.read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return cleaning.filter_by_date_range(o, "1995-01-01", "1995-12-31")


@query("active_suppliers", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0")
def _(spark, sf):
    s = bindings.read(spark, sf, "supplier").withColumn("ended", F.when(F.col("s_acctbal") < 0, F.lit("1998-01-01")))
    return cleaning.filter_active(s, "ended").select("s_suppkey", "s_name")


@query("customer_listing", """SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'""")
def _(spark, sf):
    c = bindings.read(spark, sf, "customer").withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.lit("1998-01-01")))
    return cleaning.listing(c, {"c_mktsegment": "BUILDING", "c_name": None}, "deleted_at", [F.desc("c_acctbal"), F.asc("c_custkey")]).select(
        "c_custkey", "c_mktsegment", "c_acctbal")


@query("tagged_parts", """SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand = 'Brand#3' OR p_type = 'PROMO'""")
def _(spark, sf):
    p = bindings.read(spark, sf, "part").withColumn("tags", F.array("p_brand", "p_type"))
    return cleaning.has_tag(p, "tags", "Brand#3").unionByName(cleaning.has_tag(p, "tags", "PROMO")).dropDuplicates(["p_partkey"]).select(
        "p_partkey", "p_brand", "p_type")


@query("order_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def _(spark, sf):
    return cleaning.lookup(bindings.read(spark, sf, "orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey", "o_totalprice")


@query("email_check", """SELECT c_custkey, regexp_matches(mail, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS valid FROM (SELECT c_custkey,
  CASE c_custkey % 4 WHEN 0 THEN c_name || '@example.com' WHEN 1 THEN c_name || '@example' WHEN 2 THEN c_name || ' x@example.com' ELSE c_name || '@a@b.c' END AS mail FROM customer)""")
def _(spark, sf):
    k = F.col("c_custkey") % 4
    mail = F.concat("c_name", F.when(k == 0, "@example.com").when(k == 1, "@example").when(k == 2, " x@example.com").otherwise("@a@b.c"))
    return bindings.read(spark, sf, "customer").select("c_custkey", cleaning.valid_email(mail).alias("valid"))


@query("campaigns_clean", """SELECT p_partkey AS campaign_id, p_size AS start_date, p_retailprice AS end_date FROM part WHERE p_size > 5""")
def _(spark, sf):
    p = bindings.read(spark, sf, "part").select(
        F.col("p_partkey").alias("campaign_id"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("start_date"), F.col("p_retailprice").alias("end_date"))
    return cleaning.clean_campaigns(p.unionByName(p))


@query("tables_cleaned", "SELECT 'customers' AS name, COUNT(*) AS n FROM customer UNION ALL SELECT 'suppliers', COUNT(*) FROM supplier")
def _(spark, sf):
    c, s = (bindings.read(spark, sf, t).select(F.col(k).alias("id")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey")))
    out = cleaning.clean_all({"customers": c.unionByName(c), "suppliers": s})
    count = lambda n: out[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return count("customers").unionByName(count("suppliers"))
