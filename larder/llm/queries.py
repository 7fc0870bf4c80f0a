"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.llm import ann, decontam, dialogue, htmltext, linededup, lm, mixing, neardup, phrases, quality, sharding, sigtree, toxicity
from larder.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(key: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return wrap


@query("op6_sharding")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = sharding.byte_shards(docs, 40, keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_decontamination", f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({LOWER_SQL.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({LOWER_SQL.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS x
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n),
hit AS (SELECT s.doc_id, s.i, s.n, v.item_id FROM spot s JOIN win v ON v.n = s.n AND v.x = s.w[s.i:s.i + s.n - 1]),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    hit = decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return hit.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op9_mixing")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), target_entropy=0.97, max_repeat=4.0, keep=["doc_id", "source"])


@query("op10_line_dedup", f"""
WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, {LOWER_SQL.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM line),
first AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first IS NULL OR first >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN first USING (k) GROUP BY doc_id
""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op1_ann")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), every=20, k=20)


@query("op5_near_duplicates", f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0),
shingle AS (SELECT DISTINCT doc_id, w[i:i + 2] AS s FROM spot),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM step UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM doc d LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), width=3, percent=85)


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return lm.score_documents(table(spark, sf, "documents"))


@query("op3_quality")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_html")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    text = htmltext.main_text(table(spark, sf, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: crc32 bit by bit: each byte is xored in and followed by eight shifts.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({}, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
       lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT)"""


@query("op11_conversation_repair", f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_CRC_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE h <> 0),
seq AS (SELECT conv_id, turn, role, text, rtrim(text, {_SPACE_SQL}) AS body, left(role, 1) AS c,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM dam),
f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS two FROM seq),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
move(c, p, q) AS (VALUES ('s', '0', 'S'), ('u', '0', 'U'), ('u', 'S', 'U'), ('u', 'A', 'U'), ('a', 'U', 'A')),
hop(p, q, cost, audit) AS (VALUES ('0', '0', 0, ''), ('S', 'S', 0, ''), ('U', 'U', 0, ''), ('A', 'A', 0, ''), ('0', 'U', 2, 'I'), ('0', 'A', 4, 'II'),
  ('S', 'U', 2, 'I'), ('S', 'A', 4, 'II'), ('U', 'A', 2, 'I'), ('A', 'U', 2, 'I')),
edit(c, p, q, cost, audit) AS (SELECT NULL::VARCHAR, p, p, 3, 'D' FROM hop WHERE p = q UNION ALL SELECT NULL::VARCHAR, p, q, 2, 'R' FROM move WHERE c <> 's' UNION ALL SELECT c, p, q, 0, 'K' FROM move),
best(conv_id, i, q, x) AS (SELECT conv_id, 0::BIGINT, q, printf('%012d', cost) || audit FROM facts, hop WHERE p = '0'
  UNION ALL
  SELECT b.conv_id, b.i + 1, h.q, min(printf('%012d', left(b.x, 12)::BIGINT + e.cost + h.cost + CASE WHEN f.fault = 't' AND e.audit <> 'D' THEN 1 ELSE 0 END) || substr(b.x, 13) || e.audit || h.audit)
  FROM best b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN edit e ON e.p = b.q AND (e.c IS NULL OR e.c = f.c) AND (e.audit = 'D' OR f.fault NOT IN ('b', 'd'))
  JOIN hop h ON h.p = e.q GROUP BY b.conv_id, b.i + 1, h.q),
fin AS (SELECT b.conv_id, min(x) AS x FROM best b JOIN facts ON facts.conv_id IS NOT DISTINCT FROM b.conv_id AND n = i WHERE q IN ('0', 'A') GROUP BY b.conv_id),
letter AS (SELECT conv_id, substr(x, 13) AS audit, unnest(range(1, length(x) - 11)) AS k FROM fin),
step AS (SELECT conv_id, k, audit[k] AS e, k - length(replace(left(audit, k), 'I', '')) AS ins FROM letter),
made AS (SELECT s.conv_id, k, e, f.role, CASE WHEN e = 'I' THEN '' ELSE f.text END AS text, row_number() OVER (PARTITION BY s.conv_id ORDER BY k) AS o,
  first_value(CASE WHEN e = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id ORDER BY k) AS sys
  FROM step s LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND s.e <> 'I' AND f.i = s.k - s.ins WHERE e <> 'D'),
said AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS t FROM made GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(x, 12)::BIGINT, 0) AS cost, coalesce(substr(x, 13), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM d.conv_id
""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return dialogue.repair(rows, dialogue.damaged(rows))


@query("op12_collocations", f"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_SQL.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece),
spot AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
gram AS (SELECT lang, ws[i:i + n - 1] AS ws, n FROM spot, (SELECT unnest(range(1, 5)) AS n) WHERE i + n - 1 <= len(ws)),
f AS (SELECT lang, n AS size, array_to_string(ws, ' ') AS phrase, ws, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, ws, f AS a FROM f WHERE size >= 2 AND f >= 30),
cut AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:c.size], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT c.lang, array_to_string(c.ws[i:i + n - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size)) AS i FROM cand WHERE size > 2) c, (SELECT unnest([2, 3]) AS n) WHERE n < size AND i + n - 1 <= size GROUP BY ALL),
held AS (SELECT b.* FROM best b LEFT JOIN inside s USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM held JOIN total USING (lang) QUALIFY rank <= 2000
""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


@query("op13_jaccard_join", f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0),
shingle AS (SELECT DISTINCT doc_id, w[i:i + 2] AS s FROM spot),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * x >= 90 * (p.n + q.n - x)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM step UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM doc d LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return sigtree.jaccard_components(table(spark, sf, "documents"), width=3, percent=90)
