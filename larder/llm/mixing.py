"""Mixing sources to target weights by temperature, with DataFrame operations only.

A source with share p of all tokens gets weight p^a / sum p^a. The exponent is
found by bisection on aggregates over the table of sources: the largest one
whose entropy reaches the target, raised where that would repeat a source more
often than allowed. The largest source is passed once in whole, which sets the
scale of the budgets: every other source is repeated until its weight is met,
and no document is lost.

A pass over a source is a permutation of blocks of about ``block_rows``
documents by seeded hash. The last, partial pass takes whole blocks in that
order and, of the block at the cut, documents in hash order; both cuts are two
hash values per source, so texts are filtered where they lie, not shuffled.
A source with a third of all rows is cut like any other: only its blocks' totals meet.

Null sources are one source of their own. Null and empty texts have no words:
they cost nothing and follow their block. A source without words is passed once.
Rows that share an id and a text are taken or left together. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from larder.llm.common import written

STEPS = 15  # exponents tried in one aggregate: four bisection steps at once


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measures(sources: DataFrame, tried: list[float]) -> list[tuple[float, float]]:
    """(entropy over its maximum, largest repetition) at each exponent, in one aggregate."""
    live = sources.where("tokens > 0").withColumn("lp", F.log("tokens"))
    top = live.agg(F.max("lp").alias("top"), F.min("lp").alias("low"), F.count(F.lit(1)).alias("n")).first()
    if not top["n"]:
        return [(1.0, 1.0)] * len(tried)
    x = [F.exp(a * (F.col("lp") - top["top"])) for a in tried]
    got = live.agg(*[F.sum(e).alias(f"z{i}") for i, e in enumerate(x)],
                   *[F.sum(e * a * (F.col("lp") - top["top"])).alias(f"s{i}") for i, (a, e) in enumerate(zip(tried, x))]).first()
    out = []
    for i, a in enumerate(tried):
        h = math.log(got[f"z{i}"]) - got[f"s{i}"] / got[f"z{i}"]
        out.append((h / math.log(top["n"]) if top["n"] > 1 else 1.0, math.exp((1 - a) * (top["top"] - top["low"]))))
    return out


def _bisect(sources: DataFrame, holds_at_low: bool, test, rounds: int = 6) -> float:
    """The exponent in [0, 1] at which ``test`` flips, to 16^-rounds; 0 or 1 where it never does."""
    low, high = 0.0, 1.0
    ends = [test(*m) for m in _measures(sources, [low, high])]
    if ends[0] == ends[1]:
        return (1.0 if holds_at_low else 0.0) if ends[0] else (0.0 if holds_at_low else 1.0)
    for _ in range(rounds):
        grid = [low + (high - low) * (i + 1) / (STEPS + 1) for i in range(STEPS)]
        ok = [test(*m) for m in _measures(sources, grid)]
        edges = [low, *grid, high]
        k = sum(ok) if holds_at_low else STEPS - sum(ok)
        low, high = edges[k], edges[k + 1]
    return round(low if holds_at_low else high, 7)


def exponent(sources: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None) -> float:
    """Largest exponent whose entropy (of its maximum, 0 to 1) is at least ``target_entropy``, but not so
    small that a source repeats more than ``max_repeat`` times. Without either: 1, the natural shares."""
    a = 1.0 if max_repeat is None or target_entropy is not None else 0.0
    if target_entropy is not None:
        a = _bisect(sources, True, lambda h, _: h >= target_entropy)
    if max_repeat is not None:
        a = max(a, _bisect(sources, False, lambda _, r: r <= max_repeat))
    return a


def _keys(source: str, id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("")).alias("key"),
            F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("doc")]


def plan(df: DataFrame, target_entropy: float | None, max_repeat: float | None, seed: int, source: str, id_col: str,
         text_col: str, block_rows: int) -> DataFrame:
    """One row per source: tokens, documents, weight, budget, whole passes and the two cuts of the partial one."""
    docs = df.select(*_keys(source, id_col, text_col), word_count(F.col(f"`{text_col}`")).alias("tokens"))
    # cells of a fixed number per source bound the first aggregate; blocks are runs of cells
    cells = written(docs.groupBy("key", F.pmod("doc", F.lit(1 << 16)).alias("cell")).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-cells")
    sources = written(cells.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / block_rows)).cast("long")), "mix-sources")
    a = exponent(sources, target_entropy, max_repeat)
    top = sources.agg(F.max("tokens")).first()[0] or 1
    share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(top)), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.sum(share)).first()[0] or 1.0
    budget = F.round(share * float(top), 3).cast("long")
    sources = sources.withColumn("weight", share / z).withColumn("budget", F.greatest(budget, F.col("tokens"))).withColumn(
        "passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int")).withColumn(
        "rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0))
    block = F.pmod("cell", "blocks")
    # dealt by block, so that the cells of a hot source don't meet in one task
    by_block = cells.join(sources, "key").where("rest > 0").select(
        "key", "rest", block_hash(seed, F.col("passes") + 1, block).alias("bh"), cells["tokens"].alias("t")).repartition(
        "key", "bh").groupBy("key", "rest", "bh").agg(F.sum("t").alias("t"))
    w = Window.partitionBy("key").orderBy("bh")
    at = by_block.withColumn("upto", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = at.where("upto > rest").groupBy("key").agg(
        F.min("bh").alias("cut_block"), F.min_by(F.col("rest") - F.col("upto") + F.col("t"), "bh").alias("left_over"))
    edge = sources.join(cut, "key")
    inside = docs.join(edge.select("key", "passes", "blocks", "cut_block", "left_over"), "key").where(
        block_hash(seed, F.col("passes") + 1, _block()) == F.col("cut_block")).groupBy(
        "key", "left_over", doc_hash(seed, F.col("passes") + 1, F.col("doc")).alias("dh")).agg(F.sum("tokens").alias("t"))
    w = Window.partitionBy("key").orderBy("dh")  # one block of each source
    taken = inside.withColumn("upto", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("upto <= left_over").groupBy(
        "key").agg(F.max("dh").alias("cut_doc"))
    return written(sources.join(cut, "key", "left").join(taken, "key", "left"), "mix-plan")


def _block() -> Column:
    return F.pmod(F.pmod("doc", F.lit(1 << 16)), "blocks")


def block_hash(seed: int, epoch: Column, block: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), block.cast("long"))


def doc_hash(seed: int, epoch: Column, doc: Column) -> Column:
    return F.xxhash64(F.lit(seed + 1), epoch.cast("int"), doc)


def mix(df: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None, seed: int = 17, source: str = "source",
        id_col: str = "doc_id", text_col: str = "text", block_rows: int = 512, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every document, once per pass that takes it, with epoch (from 1), weight (of its
    source), n_tokens, block_key and doc_key; reading by (epoch, block_key, doc_key) is the mixed order."""
    added = ["epoch", "weight", "n_tokens", "block_key", "doc_key"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    table = plan(df, target_entropy, max_repeat, seed, source, id_col, text_col, block_rows)
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r"), F.col(f"`{text_col}`").alias("txt"), *_keys(source, id_col, text_col))
    rows = docs.join(table.select("key", "weight", "passes", "blocks", "rest", "cut_block", "cut_doc"), "key").withColumn(
        "epoch", F.explode(F.sequence(F.lit(1), F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0)))).withColumn(
        "block_key", block_hash(seed, F.col("epoch"), _block())).withColumn("doc_key", doc_hash(seed, F.col("epoch"), F.col("doc")))
    taken = (F.col("epoch") <= F.col("passes")) | F.col("cut_block").isNull() | (F.col("block_key") < F.col("cut_block")) | (
        (F.col("block_key") == F.col("cut_block")) & F.coalesce(F.col("doc_key") <= F.col("cut_doc"), F.lit(False)))
    return rows.where(taken).select(*[F.col(f"r.`{c}`").alias(c) for c in keep], "epoch", "weight", word_count(F.col("txt")).alias("n_tokens"),
                                    "block_key", "doc_key")
