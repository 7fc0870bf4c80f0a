"""Tokens, near duplicates, decontamination, line dedup, components."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import decontam, linededup, neardup, queries, tokens
from larder.llm.components import components
from tests.llm import brute

DOC = "doc_id long, text string, shard string, n_shingles int, n_hit string"


def docs(spark, rows):
    """Rows with extra columns whose names clash with outputs."""
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOC)


def sample(spark, sf, n=None):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:n]


ODD = [None, "", "  \t", "É é Ü", "one", "one two", " a\x0bB\x0cc\r\nd ", "x " * 40000, "ünïcode Wörter überall hier"]


def test_words_and_hashes():
    texts = [t for t in ODD] + ["A b", "a B"]
    got = [[] for _ in texts]
    seen = {}
    for i, j, data, at in tokens.walk(pa.array(texts)):
        s, e, row = tokens.spans(data, at)
        for a, b, r, h in zip(s, e, row, tokens.hashes(data, s, e)):
            w = bytes(data[a:b]).decode().translate(brute.LOWER)
            got[i + r].append(w)
            assert seen.setdefault(w, h) == h
    assert got == [brute.words(t) for t in texts] and len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("width", [1, 3, 5])
def test_shingle_sets(width):
    texts = [t or "" for t in ODD] + ["a b c a b c a b c", "a b c d e f", "a b c d e f"]
    s = neardup.sets(texts, width)
    assert [len(x) for x in s] == [len(brute.shingles(t, width)) for t in texts]
    assert (s[-1] == s[-2]).all()
    assert len(np.intersect1d(s[-1], s[-3])) == len(brute.shingles(texts[-1], width) & brute.shingles(texts[-3], width))


def test_components_match_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.components({x for p in links for x in p}, links)
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(spark, rows, **kw):
    return {(r["doc_id"]): (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, rows), **kw).collect()}


@pytest.mark.parametrize("small,block", [(neardup.SMALL, neardup.BLOCK_SHINGLES), (2, 400)])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)  # also every open bucket in blocks
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(4000)]
    rows, base = [], [[rng.choice(vocab) for _ in range(80)] for _ in range(6)]
    for i in range(130):  # groups of near copies around the threshold, unlike documents, short ones
        w = list(base[i % 6])
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(80)] = rng.choice(vocab)
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    rows += [(3000 + i, "The Same Text, copied often enough to matter") for i in range(50)]
    want = brute.near_duplicates(dict(rows), 3, 85)
    got = near(spark, rows, width=3, percent=85)
    assert {i: c for i, (_, c, _) in got.items()} == want
    assert all(n == len(brute.shingles(dict(rows)[i], 3)) and kept == (c == i) for i, (n, c, kept) in got.items())


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 65536, (400, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for i in range(400):  # at the radius exactly, wherever the errors fall
        b[i, rng.choice(neardup.SYMBOLS, neardup.radius(), replace=False)] += 1
    x, y = neardup.chunk_keys(a), neardup.chunk_keys(b)
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist()))
    assert neardup.miss_chance(0.85) < 1e-4 and neardup.miss_chance(0.8) < 1e-3


def test_near_duplicate_odd_rows(spark):
    rows = list(enumerate(ODD)) + [(None, "one two"), (None, None), (5, "one two"), (5, "one two"), (90, "ONE  two\n")]
    got = neardup.near_duplicates(docs(spark, rows), width=3, percent=85).collect()
    assert len(got) == len(rows)
    at = {r["doc_id"]: r for r in got}
    assert at[0]["n_shingles"] == at[1]["n_shingles"] == at[2]["n_shingles"] == 0 and at[0]["kept"] and at[1]["component_id"] == 1
    assert at[90]["component_id"] == 5 and not at[90]["kept"] and at[None]["component_id"] is None and at[None]["kept"]
    kept = neardup.keep_one(docs(spark, rows), 3, 85)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs(spark, rows).columns and ids.count(5) == 1 and 90 not in ids and ids.count(None) == 2
    assert near(spark, []) == {}


def test_contamination_matches_search(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "c", "é", "Ü", "x1"]
    text = lambda n: rng.choice([" ", ", ", "--\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(30)] + [(7, None), (None, "null item id"), (99, "!!!")]
    rows = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "so Null ITEM, id!"), (102, "x " * 50000), (None, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 200):  # one automaton, and many parts
        got = decontam.contamination(docs(spark, rows), bench, max_bytes=limit, keep=["doc_id", "text", "n_hit"]).collect()
        assert len(got) == len(rows)
        for r in got:
            n, hit, ids = brute.contamination(r["text"], items)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, sorted(str(i) for i in ids - {None}))
            spans = [r["text"][s["start"]: s["end"]] for s in r["spans"]]
            assert sum(len(brute.benchmark_words(x)) for x in spans) == hit
    assert decontam.contamination(docs(spark, []), bench).count() == 0
    none = decontam.contamination(docs(spark, rows), bench.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(rows)


def test_line_dedup_matches_search(spark):
    rng = random.Random(6)
    pool = [f"a line that repeats, number {i}" for i in range(12)] + ["short", "", "   ", "\tA Line That Repeats, Number 3 "]
    rows = [(rng.randrange(1000), "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for _ in range(80)]
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (None, pool[0]), (2003, "x" * 100000), (2004, "x" * 100000), (2004, "x" * 100000), (2005, "é" * 9), (2006, "é" * 9)]
    for batches, fanout in ((4, 2), (1, 2), (7, 3)):
        got = linededup.dedup_lines(docs(spark, rows), batches=batches, fanout=fanout).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.line_dedup(rows)))
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_runs_are_compacted_and_disjoint(spark):
    runs = linededup.Runs(2)
    for k in range(4):
        runs.add(spark.range(0, 50).select((F.col("id") + 20 * k).alias("ha"), F.lit(0).cast("long").alias("hb"), (F.col("id") + 100 * k).alias("id")))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    held = runs.holders()
    assert held.count() == held.select("ha").distinct().count() == 110


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf, key):
    import duckdb
    from scripts.check import rows
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[key](spark, sf)
    cur = con.execute(queries.ORACLES[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()], 9) == rows(cols, [tuple(r) for r in cur.fetchall()], 9)


def test_line_dedup_of_text_ids(spark):
    rows = [(f"d{i:02d}", f"own line number {i}\nA line that all of them share\nshort") for i in range(30)] + [(None, "A line that all of them share")]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string"))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()}
    assert got == {i: (n, d, t) for i, n, d, t in brute.line_dedup(rows)}
