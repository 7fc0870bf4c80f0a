"""Ledgers, vectors, text and row formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.exprs import exact_sum, rnd
from larder.operators import joins, ledger, retrieval, scalars
from larder.plans import frames, p_joins
from larder.plans.registry import query
from larder.plans.sqlbase import CTES, Q
from larder.sources import bindings

_TYPES = {"purchase": "RECEIVE", "signup": "COUNT", "click": "SALE", "view": "WASTE", "error": "SALE"}


def stock_events(spark, sf):
    e = bindings.read(spark, sf, "events")
    t, v = F.col("event_type"), F.col("value")
    return e.select(
        "event_id", "ts", F.col("user_id").alias("ingredient_id"), (F.col("event_id") % 2).alias("location_id"),
        F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])[t].alias("adjustment_type"),
        F.when(t == "purchase", F.ceil(v)).when(t == "signup", 0).when(t == "view", -F.floor(v / 5)).otherwise(-F.floor(v / 2)).cast("double").alias("quantity"),
        F.when(t == "purchase", v / 10).alias("unit_cost"))


_X = """CASE event_type WHEN 'purchase' THEN CEIL(value) WHEN 'signup' THEN 0 WHEN 'view' THEN -FLOOR(value / 5) ELSE -FLOOR(value / 2) END"""
_TY = "CASE event_type WHEN 'purchase' THEN 'RECEIVE' WHEN 'signup' THEN 'COUNT' WHEN 'view' THEN 'WASTE' ELSE 'SALE' END"
CTES["sev"] = ([], f"""SELECT event_id, ts, user_id AS ingredient_id, event_id % 2 AS location_id, {_TY} AS adjustment_type, CAST({_X} AS DOUBLE) AS quantity,
  CASE WHEN event_type = 'purchase' THEN value / 10 END AS unit_cost, ROW_NUMBER() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS rn FROM events""")


def RQ(seed: str, keys: str, final: str) -> str:
    """Recursive check: walk each key's events in order and reject steps below 0."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"s.{k} = r.{k}" for k in ks)
    cols = ", ".join(f"s.{k}" for k in ks)
    return (f"WITH RECURSIVE ev AS ({seed}), rec AS (SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS event_id, 0.0::DOUBLE AS b, 0.0::DOUBLE AS a, TRUE AS ok FROM ev "
            f"UNION ALL SELECT {cols}, s.rn, s.event_id, r.a, CASE WHEN r.a + s.x >= 0 THEN r.a + s.x ELSE r.a END, r.a + s.x >= 0 FROM rec r JOIN ev s ON {on} AND s.rn = r.rn + 1), "
            f"led AS (SELECT ev.*, rec.b AS quantity_before, rec.a AS quantity_after, rec.ok AS accepted FROM rec JOIN ev USING (event_id) WHERE rec.rn > 0) {final}")


_SEV = f"SELECT *, quantity AS x FROM ({CTES['sev'][1]})"


@query("stock_ledger", RQ(_SEV, "ingredient_id, location_id", """SELECT event_id, ingredient_id, location_id, adjustment_type, quantity, quantity_before, quantity_after, accepted,
  CASE WHEN accepted AND unit_cost IS NOT NULL THEN unit_cost * ABS(quantity) END AS total_cost FROM led"""))
def _(spark, sf):
    return ledger.stock_ledger(stock_events(spark, sf), ["ingredient_id", "location_id"]).drop("ts", "unit_cost")


@query("stock_levels", RQ(_SEV, "ingredient_id, location_id", """SELECT ingredient_id, location_id, ARG_MAX(quantity_after, rn) AS quantity,
  strftime(MAX(ts) FILTER (accepted AND adjustment_type = 'RECEIVE'), '%Y-%m-%d %H:%M:%S') AS last_restocked_at,
  strftime(MAX(ts) FILTER (accepted AND adjustment_type = 'COUNT'), '%Y-%m-%d %H:%M:%S') AS last_counted_at, COUNT(*) FILTER (NOT accepted) AS rejected FROM led GROUP BY ALL"""))
def _(spark, sf):
    keys = ["ingredient_id", "location_id"]
    out = ledger.stock_levels(ledger.stock_ledger(stock_events(spark, sf), keys), keys)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("last_restocked_at", "last_counted_at")})


@query("stock_floor_ledger", Q("sev", "s AS (SELECT *, SUM(quantity) OVER (PARTITION BY ingredient_id, location_id ORDER BY rn) AS t FROM sev)",
       "m AS (SELECT *, LEAST(0, COALESCE(MIN(t) OVER (PARTITION BY ingredient_id, location_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS mn FROM s)",
       "SELECT event_id, ingredient_id, location_id, quantity, t - quantity - mn AS quantity_before, GREATEST(t - mn, 0) AS quantity_after FROM m"))
def _(spark, sf):
    return ledger.floored_ledger(stock_events(spark, sf), ["ingredient_id", "location_id"], "ts", "event_id", "quantity").select(
        "event_id", "ingredient_id", "location_id", "quantity", "quantity_before", "quantity_after")


def point_events(spark, sf):
    e = bindings.read(spark, sf, "events")
    earn = F.col("event_type").isin("purchase", "signup", "view")
    return e.select("event_id", "ts", F.col("user_id").alias("member_id"), F.when(earn, "earn").otherwise("redeem").alias("type"),
                    F.ceil("value").alias("points"))


def members(spark, sf):
    e = bindings.read(spark, sf, "events")
    m = e.select(F.col("user_id").alias("member_id")).distinct().withColumn("tier_id", F.col("member_id") % 4)
    tiers = m.where(F.col("tier_id") < 3).select("tier_id").distinct().withColumn("points_multiplier", F.col("tier_id") / 4 + 1)
    return m, tiers


_PEV = """SELECT event_id, ts, user_id AS member_id, CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'earn' ELSE 'redeem' END AS type,
  CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN FLOOR(CEIL(value) * CASE WHEN user_id % 4 < 3 THEN 1 + (user_id % 4) / 4 ELSE 1 END) ELSE -CEIL(value) END AS x,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"""


@query("points_ledger", RQ(_PEV, "member_id", "SELECT event_id, member_id, type, x AS change, quantity_before, quantity_after, accepted FROM led"))
def _(spark, sf):
    return ledger.points_ledger(point_events(spark, sf), *members(spark, sf)).drop("ts", "points")


@query("member_totals", RQ(_PEV, "member_id", """SELECT member_id, ARG_MAX(quantity_after, rn) AS points, COALESCE(SUM(x) FILTER (accepted AND x > 0), 0) AS total_earned,
  COALESCE(SUM(-x) FILTER (accepted AND x < 0), 0) AS total_redeemed, COUNT(*) FILTER (NOT accepted) AS rejected FROM led GROUP BY member_id"""))
def _(spark, sf):
    return ledger.member_totals(ledger.points_ledger(point_events(spark, sf), *members(spark, sf)))


_CEV = """SELECT event_id, ts, user_id AS member_id, event_type, CASE WHEN event_type = 'purchase' THEN CEIL(value) ELSE -CEIL(value / 3) END AS x,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('purchase', 'click')"""


@query("credit_ledger", RQ(_CEV, "member_id", "SELECT event_id, member_id, x AS amount, quantity_after AS balance, accepted FROM led"))
def _(spark, sf):
    e = bindings.read(spark, sf, "events").where(F.col("event_type").isin("purchase", "click")).select(
        "event_id", "ts", F.col("user_id").alias("member_id"),
        F.when(F.col("event_type") == "purchase", F.ceil("value")).otherwise(-F.ceil(F.col("value") / 3)).cast("double").alias("amount"))
    return ledger.rejecting_ledger(e, ["member_id"], "ts", "event_id", "amount").select(
        "event_id", "member_id", "amount", F.col("quantity_after").alias("balance"), "accepted")


_ST = {"click": "OPEN", "view": "IN_PROGRESS", "purchase": "READY", "signup": "COMPLETED", "error": "CANCELLED"}
_STSQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ST.items()) + " END"


@query("open_orders", f"""SELECT order_id, status, strftime(last_change, '%Y-%m-%d %H:%M:%S') AS last_change, ROUND(m, 4) AS elapsed_minutes,
  CASE WHEN m >= 5 THEN 'red' WHEN m >= 2 THEN 'amber' ELSE 'normal' END AS tier, CAST(FLOOR(m) AS BIGINT) || ':' || LPAD(CAST(CAST(ROUND((m - FLOOR(m)) * 60) AS BIGINT) AS VARCHAR), 2, '0') AS timer
FROM (SELECT order_id, status, last_change, (epoch_us((SELECT MAX(ts) FROM events)) - epoch_us(last_change)) / 60000000 AS m FROM
  (SELECT user_id AS order_id, ARG_MAX({_STSQL}, event_id) AS status, MAX(ts) AS last_change FROM events GROUP BY 1)) WHERE status IN ('OPEN', 'IN_PROGRESS', 'READY')""")
def _(spark, sf):
    e = bindings.read(spark, sf, "events")
    s = e.select("event_id", "ts", F.col("user_id").alias("order_id"), F.create_map(*[F.lit(x) for kv in _ST.items() for x in kv])[F.col("event_type")].alias("status"))
    now = e.agg(F.max("ts").alias("t")).scalar()
    return ledger.open_orders(s, now, ["OPEN", "IN_PROGRESS", "READY"]).withColumns({
        "last_change": F.date_format("last_change", "yyyy-MM-dd HH:mm:ss"), "elapsed_minutes": rnd("elapsed_minutes", 4)})


@query("order_timers", """SELECT event_id, ROUND(m, 4) AS elapsed_minutes, CASE WHEN m >= 5 THEN 'red' WHEN m >= 2 THEN 'amber' ELSE 'normal' END AS tier,
  CAST(FLOOR(m) AS BIGINT) || ':' || LPAD(CAST(CAST(ROUND((m - FLOOR(m)) * 60) AS BIGINT) AS VARCHAR), 2, '0') AS timer
FROM (SELECT event_id, (epoch_us(MAX(ts) OVER (PARTITION BY CAST(ts AS DATE))) - epoch_us(ts)) / 60000000 AS m FROM events)""")
def _(spark, sf):
    e = bindings.read(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("d"))
    close = e.groupBy("d").agg(F.max("ts").alias("closing"))
    return ledger.timers(e.join(close, "d"), "ts", F.col("closing")).select(
        "event_id", rnd("elapsed_minutes", 4).alias("elapsed_minutes"), "tier", "timer")


# ---- text and formats ---------------------------------------------------------------

@query("cart_totals", """SELECT order_id, subtotal, item_count, CAST(ROUND(subtotal * 0.05) AS BIGINT) AS tax, subtotal + CAST(ROUND(subtotal * 0.05) AS BIGINT) AS total FROM (SELECT l_orderkey AS order_id,
  CAST(SUM(CAST(ROUND(p_retailprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS subtotal, CAST(SUM(l_quantity) AS BIGINT) AS item_count FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)""")
def _(spark, sf):
    l = frames.lines(spark, sf).select("order_id", F.round(F.col("price") * 100).cast("long").alias("price_cents"), F.col("quantity").cast("long").alias("quantity"))
    return scalars.cart_totals(l)


@query("label_encode", """WITH k AS (SELECT l, ROW_NUMBER() OVER (ORDER BY l) - 1 AS i FROM (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS l FROM part WHERE p_size <= 40)),
b AS (SELECT l, ROW_NUMBER() OVER (ORDER BY l) - 1 AS i FROM (SELECT DISTINCT p_brand AS l FROM part WHERE p_brand <> 'Brand#4'))
SELECT p_partkey, p_brand, COALESCE(k.i, -1) AS item_id_encoded, COALESCE(b.i, -1) AS brand_encoded FROM part LEFT JOIN k ON k.l = CAST(p_partkey AS VARCHAR) LEFT JOIN b ON b.l = p_brand""")
def _(spark, sf):
    p = bindings.read(spark, sf, "part")
    out = scalars.label_encode(p.select("p_partkey", "p_brand"), p.where(F.col("p_size") <= 40), "p_partkey", "item_id_encoded")
    return scalars.label_encode(out, p.where(F.col("p_brand") != "Brand#4"), "p_brand", "brand_encoded")


@query("perishable_flag", "WITH f AS (SELECT p_partkey AS id, REPLACE(REPLACE(REPLACE(p_name, 'widget', 'Egg sandwich'), 'bolt', 'Juice'), 'ring', 'Sushi') AS name FROM part) SELECT id, name, " + ", ".join(
    "(" + " OR ".join(f"name ILIKE '%{w}%'" for w in ws) + f") AS {k}" for k, ws in scalars.PERISHABLE_WORDS.items()) + " FROM f")
def _(spark, sf):
    from larder.operators.baselines import matches_any
    name = F.col("p_name")
    for a, b in (("widget", "Egg sandwich"), ("bolt", "Juice"), ("ring", "Sushi")):
        name = F.replace(name, F.lit(a), F.lit(b))
    p = bindings.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    return p.select("id", "name", *[matches_any(F.col("name"), ws).alias(k) for k, ws in scalars.PERISHABLE_WORDS.items()])


@query("metric_format", """SELECT c_custkey, ROUND((c_acctbal - b) * 100 / NULLIF(b, 0), 6) AS change_pct, CASE WHEN c_acctbal / 100 < 50 THEN 'poor' WHEN c_acctbal / 100 < 70 THEN 'fair' WHEN c_acctbal / 100 < 90 THEN 'good' ELSE 'excellent' END AS tier,
  'DKK ' || format('{:,.2f}', c_acctbal) AS amount, CASE WHEN ABS(v) >= 1e6 THEN format('{:,.1f}', v / 1e6) || 'M DKK' WHEN ABS(v) >= 1e3 THEN format('{:,.0f}', v / 1e3) || 'K DKK' ELSE format('{:,.0f}', v) || ' DKK' END AS short
FROM (SELECT *, CAST(c_custkey % 5 * 100 AS DOUBLE) AS b, c_acctbal * 321 AS v FROM customer)""")
def _(spark, sf):
    c = bindings.read(spark, sf, "customer").withColumn("b", (F.col("c_custkey") % 5 * 100).cast("double"))
    return c.select("c_custkey", rnd(scalars.percentage_change("b", "c_acctbal")).alias("change_pct"),
                    scalars.performance_tier(F.col("c_acctbal") / 100).alias("tier"), scalars.currency("c_acctbal").alias("amount"),
                    scalars.short_dkk(F.col("c_acctbal") * 321).alias("short"))


@query("recipe_text", Q("menu", """SELECT parent_title AS recipe, 0 AS chunk, parent_title || ': ' || STRING_AGG(ingredient || ' ' || CAST(quantity AS VARCHAR) || unit, ', ' ORDER BY ingredient, quantity, unit) AS text FROM menu GROUP BY parent_title"""))
def _(spark, sf):
    m = p_joins.menu(spark, sf).select(F.col("parent_title").alias("recipe"), "ingredient", "quantity", "unit")
    return scalars.recipe_text(m)


# ---- vectors -----------------------------------------------------------------------

CTES["cent"] = ([], """SELECT label, LIST(m ORDER BY pos) AS vector FROM (SELECT label, pos, ROUND(CAST(SUM(CAST(v AS DECIMAL(28,12))) AS DOUBLE) / COUNT(*), 9) AS m FROM
  (SELECT label, UNNEST(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label""")


@query("similar_recipes", Q("cent bom", """sim AS (SELECT c.label AS query_id, e.vec_id, ROUND(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.vector), 6) AS score FROM embeddings e CROSS JOIN cent c)""",
       "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sim WHERE score >= 0.4)",
       "SELECT query_id, vec_id, score, rank, (SELECT COUNT(*) FROM bom WHERE parent_sku_id = vec_id + 1000000) AS ingredients FROM r WHERE rank <= 3"))
def _(spark, sf):
    e = bindings.read(spark, sf, "embeddings")
    q = retrieval.centroids(e, "label").select(F.col("label").alias("query_id"), "vector")
    hits = retrieval.search(e, q, 3, "cosine", 0.4)
    n = bindings.bill_of_materials(spark, sf).groupBy((F.col("parent_sku_id") - 1000000).alias("vec_id")).agg(F.count(F.lit(1)).alias("ingredients"))
    return hits.join(n, "vec_id", "left").withColumn("ingredients", F.coalesce("ingredients", F.lit(0)))


CTES["lead"] = ([], "SELECT label, ARG_MIN(CAST(embedding AS DOUBLE[]), vec_id) AS vector FROM embeddings GROUP BY label")


def _first_vectors(spark, sf):
    e = bindings.read(spark, sf, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return e, q.select(F.col("label").alias("query_id"), "vector", F.col("label").alias("wanted"))


_L2 = "ROUND(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), c.vector), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"


@query("vector_search", Q("lead", f"d AS (SELECT c.label AS query_id, e.vec_id, {_L2} AS score FROM embeddings e JOIN lead c USING (label))",
       "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 5"))
def _(spark, sf):
    e, q = _first_vectors(spark, sf)
    return retrieval.search(e, q, 5, "l2", filter_col="label")


@query("context_text", Q("lead", f"d AS (SELECT c.label AS query_id, e.vec_id, {_L2} AS score FROM embeddings e CROSS JOIN lead c)",
       """k AS (SELECT d.*, CASE WHEN lang = 'en' THEN 'insight' ELSE 'rule' END AS kind, source, text FROM d JOIN documents ON doc_id = vec_id)""",
       "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, kind ORDER BY score, vec_id) AS rank FROM k)",
       """SELECT query_id, concat_ws(chr(10), '**Relevant Business Rules:**' || chr(10) || STRING_AGG('- ' || text, chr(10) ORDER BY rank) FILTER (kind = 'rule' AND rank <= 3),
  chr(10) || '**Recent Related Insights:**' || chr(10) || STRING_AGG('- [' || source || '] ' || SUBSTRING(text, 1, 200) || '...', chr(10) ORDER BY rank) FILTER (kind = 'insight' AND rank <= 5)) AS context FROM r GROUP BY query_id"""))
def _(spark, sf):
    e, q = _first_vectors(spark, sf)
    docs = bindings.read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.when(F.col("lang") == "en", "insight").otherwise("rule").alias("kind"))
    text = bindings.read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("label"), "text")
    kinds = e.join(docs, "vec_id")
    parts = [retrieval.search(kinds.where(F.col("kind") == k), q.select("query_id", "vector"), n, "l2").withColumn("kind", F.lit(k)) for k, n in (("rule", 3), ("insight", 5))]
    ranked = parts[0].unionByName(parts[1]).join(text, "vec_id")
    return retrieval.context_text(ranked)
