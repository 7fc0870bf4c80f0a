"""Shards, mixture, the pipeline, and how the subpackage is attached."""

import random
import subprocess
import sys
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import mixing, sharding, toxicity
from tests.llm import brute


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, source string, shard string, weight double")


def test_shards_match_prefix_sums(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(400), "é" * rng.randrange(60), "s") for _ in range(300)] + [(None, "abc", "s"), (7, None, "s"), (8, "", None), (9, "y" * 5000, "s")] + [(11, "same", "s")] * 120
    got = sharding.byte_shards(docs(spark, rows), 6, keep=["doc_id", "text", "shard"]).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in got)
    total, start = sum(r["size"] for r in got), 0
    by = {}
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        assert r["shard"] == min(5, (2 * start + r["size"]) * 6 // (2 * total))
        start += r["size"]
        by.setdefault(r["shard"], []).append(r)
    assert all([r["slot"] for r in rs] == list(range(len(rs))) for rs in by.values())
    order = [-1 if r["doc_id"] is None else r["doc_id"] for s in sorted(by) for r in by[s]]
    assert order == sorted(order)
    assert all(abs(sum(r["size"] for r in rs) - total / 6) <= max(r["size"] for r in got) for rs in by.values())
    assert sharding.byte_shards(docs(spark, []), 6).count() == 0


def test_written_shards(spark, tmp_path):
    out = sharding.byte_shards(docs(spark, [(i, f"text {i}", "s") for i in range(50)]).select("doc_id", "text"), 4)
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


def corpus(spark, sizes, extra=()):
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, " ".join(["w"] * (5 + k % 7)), s))
            k += 1
    return docs(spark, rows + list(extra))


def shares(df, by="source"):
    t = {r[by]: r["t"] for r in df.groupBy(by).agg(F.sum(mixing.word_count(F.col("text"))).alias("t")).collect()}
    return {s: x / sum(t.values()) for s, x in t.items()}


def test_exponent_meets_its_targets(spark):
    import math
    tokens = {"a": 9000, "b": 900, "c": 90, "d": 10}
    table = spark.createDataFrame(list(tokens.items()), "key string, tokens long")
    for target in (0.7, 0.9, 0.999):
        a = mixing.exponent(table, target)
        z = sum(t**a for t in tokens.values())
        h = -sum(t**a / z * math.log(t**a / z) for t in tokens.values()) / math.log(4)
        assert h == pytest.approx(target, abs=1e-4)
    a = mixing.exponent(table, 0.999, 4.0)  # the limit on repetition wins
    assert (9000 / 10) ** (1 - a) == pytest.approx(4.0, rel=1e-4)
    assert mixing.exponent(table) == 1.0 and mixing.exponent(table, 0.0) == 1.0 and mixing.exponent(table, None, 1e9) == 0.0
    assert mixing.exponent(spark.createDataFrame([("a", 5)], "key string, tokens long"), 0.9, 2.0) in (0.0, 1.0)


def test_mixture(spark):
    df = corpus(spark, {"hot": 900, "mid": 300, "low": 100}, [(9000, None, "hot"), (9001, "", "low"), (9002, "only", None), (9003, "", "void")])
    out = mixing.mix(df, max_repeat=3.0, block_rows=16)
    times = Counter(r["doc_id"] for r in out.collect())
    assert set(times) == {r["doc_id"] for r in df.collect()}  # no document is lost
    assert max(times.values()) <= 3 and all(times[r["doc_id"]] == 1 for r in df.where("source = 'hot'").collect())
    before, after = shares(df.where("source IN ('hot','mid','low')")), shares(out.where("source IN ('hot','mid','low')"))
    weights = {r["source"]: r["weight"] for r in out.select("source", "weight").distinct().collect()}
    z = sum(weights[s] for s in after)
    assert all(after[s] == pytest.approx(weights[s] / z, abs=0.01) for s in after) and after["low"] > before["low"]
    again = mixing.mix(df, max_repeat=3.0, block_rows=16)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out.collect()))
    wide = mixing.mix(df.where("source IS NOT NULL"), max_repeat=3.0, block_rows=16)
    assert max(Counter(r["doc_id"] for r in wide.collect()).values()) == 3


def test_mixture_of_odd_tables(spark):
    assert mixing.mix(docs(spark, []), 0.9, 2.0).count() == 0
    blank = docs(spark, [(1, None, "a"), (2, "", None)])
    assert mixing.mix(blank, 0.9, 2.0).count() == 2
    repeated = docs(spark, [(1, "a b", "s")] * 30 + [(2, "c d e", "t")])
    assert mixing.mix(repeated, max_repeat=2.0).where("doc_id = 1").count() == 30


def test_mixing_is_native(spark):
    from larder.llm import mixing as m
    plan = m.mix(corpus(spark, {"a": 20, "b": 5}), 0.99, 4.0)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline_against_plain_python(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in table.collect()}
    calm = {r["doc_id"] for r in toxicity.score_toxicity(table, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0").collect()}
    group = brute.near_duplicates({i: text[i] for i in calm}, 5, 80)
    one = {i for i, c in group.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {}
    for i, t in items:
        w = brute.benchmark_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(w[k: k + n]))
    clean = {i for i in one if not any(tuple(w[k: k + n]) in ws for w in [brute.benchmark_words(text[i])] for n, ws in windows.items() for k in range(len(w) - n + 1))}
    out = corpus_pipeline.run(spark, sf).collect()
    times = Counter(r["doc_id"] for r in out)
    assert set(times) == clean and max(times.values()) <= 2
    assert all(r["text"] == text[r["doc_id"]] for r in out)
    total, start = sum(r["size"] for r in out), 0
    for r in sorted(out, key=lambda r: (r["shard"], r["slot"])):
        assert r["shard"] == min(39, (2 * start + r["size"]) * 40 // (2 * total))
        start += r["size"]


def test_every_stage_takes_odd_tables(spark, sf):
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, "x " * 20000, "en", "t", 1), (4, "same words here and there", "en", "t", 1),
            (4, "same words here and there", "en", "t", 1), (5, "Same words here  and there", "en", "t", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        df = spark.createDataFrame([(*r, "x") for r in data], kind + ", n_hit string")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = stage(spark, df, sf)
            if k < 4:
                assert df.columns == [c.split()[0] for c in kind.split(", ")] + ["n_hit"]
        ids = Counter(r["doc_id"] for r in df.collect())
        assert set(ids) == ({1, 2, 3, 4, None} if data else set())


def test_columns_pass_through_the_pipeline(spark, sf):
    names = ["n_hit", "hit_words", "items", "weight", "epoch", "n_tokens", "row", "spans", "kept"]
    df = spark.createDataFrame([(i, f"plain words number {i} of a short text", "en", f"s{i % 2}", 5, *[f"{c}{i}" for c in names]) for i in range(6)],
                               "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    for _, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns
        assert {tuple(r) for r in out.collect()} == {tuple(r) for r in df.collect()}


def test_the_rest_imports_without_this_subpackage(tmp_path):
    code = ("import sys, builtins; real = builtins.__import__\n"
            "def no(name, *a, **k):\n"
            "    if name.startswith(('larder.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name, name=name.split('.llm')[0] + '.llm' if '.llm' in name else name)\n"
            "    return real(name, *a, **k)\n"
            "builtins.__import__ = no\nimport __spark_entry__ as e\nassert len(e.queries()) > 190 and 'pipeline' not in e.queries()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])


def test_the_rest_imports_without_the_libraries_of_this_subpackage():
    code = ("import sys\nsys.modules['zstandard'] = sys.modules['ahocorasick'] = None\n"
            "import __spark_entry__ as e\nassert len(e.queries()) > 190 and 'pipeline' not in e.queries()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])


def test_all_are_registered():
    import __spark_entry__ as e
    names = e.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
