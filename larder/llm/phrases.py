"""Phrase collocations by top-order marginalisation.

Every word of a piece of text leads one window of ``LONGEST`` words, padded with empty words at the end of its piece. Only
these longest windows are counted; Spark's ROLLUP over (lang, w1, .., w4) sums them into the counts of all shorter
phrases, for a phrase occurs once for every window that begins with it, and into the number of words per language. No
n-gram of lower order is exploded.

Before that a window is also padded where it would hold two or three words in a row that occur fewer than ``least`` times, since
no phrase that counts reaches across them, and a word that rare leads an empty window, which only counts for the number of
words. What is rare is told by 32-bit hashes counted beforehand: a collision can only keep a word, and no count of the result comes from
them. The frequent ones travel as a bitmap of at most ``FILTER_BITS`` bits. Where a corpus has more of them than the bitmap can tell apart, more windows stay long; counts are the same.

A null text is empty, a null language is ``und``. Repeated rows count as often as they occur. Empty tables and texts give no
phrases. Ranks are told apart by score, count and phrase, so there are no ties. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from larder.llm import tokens
from larder.llm.common import rows_per_batch, written
from larder.llm.tokens import U, mix

LONGEST = 4
FILTER_BITS = 1 << 27
PART_BITS = 1 << 15  # bits of one part of Spark's bitmap aggregate
_MERGE = 1 << 21  # hashes kept in a task before they are counted together

IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IS_WORD = ~IS_BREAK
IS_WORD[[0x20, 0x09]] = False


def _words(data: np.ndarray, at: np.ndarray):
    """Start, end, row, hash of each word, and whether the next word is in the same piece."""
    s, e, row = tokens.spans(data, at, IS_WORD)
    breaks = np.concatenate([[0], np.cumsum(IS_BREAK[data])]) if len(data) else np.zeros(1, dtype=np.int64)
    joined = np.zeros(len(s), dtype=bool)
    joined[:-1] = (row[:-1] == row[1:]) & (breaks[e[:-1]] == breaks[s[1:]])
    return s, e, row, tokens.hashes(data, s, e), joined


def _pair_hash(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """32-bit hash of each word and the one after it (the last one's is meaningless)."""
    return mix(h * U(0x9E3779B97F4A7C15) + np.roll(h, -1) + lang * U(0xD6E8FEB86659FD93)) >> U(32)


def _triple_hash(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """32-bit hash of each word and the two after it."""
    return mix(h * U(0x9E3779B97F4A7C15) + np.roll(h, -1) * U(0xC2B2AE3D27D4EB4F) + np.roll(h, -2) + lang * U(0x2545F4914F6CDD1D)) >> U(32)


def _word_hash(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """32-bit hash of each word."""
    return mix(h + lang * U(0xA0761D6478BD642F)) >> U(32)


def _after(x: np.ndarray, k: int) -> np.ndarray:
    """The flags k places on, none past the end."""
    return np.append(x[k:], np.zeros(min(k, len(x)), dtype=bool))


def _tally(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return h, np.bincount(at, weights=np.concatenate(counts), minlength=len(h)).astype(np.int64)


def _count_pairs(batches):
    hashes, counts = [], []

    def flush():
        h, n = _tally(hashes, counts)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    for batch in batches:
        lang = batch.column("code").to_numpy(zero_copy_only=False).view(U)
        for i, _, data, at in tokens.walk(batch.column("text")):
            _, _, row, h, joined = _words(data, at)
            own = lang[i + row]
            u, n = np.unique(np.concatenate([_word_hash(h, own), _pair_hash(h, own)[joined], _triple_hash(h, own)[joined & _after(joined, 1)]]), return_counts=True)
            hashes.append(u)
            counts.append(n)
            if sum(map(len, hashes)) >= _MERGE:
                yield flush()
                hashes, counts = [], []
    if hashes:
        yield flush()


_ODD, _PRIME = 0x1E3779B1, 4294967291


def _places(h, m):
    """Two bits of a 32-bit hash, alike for columns and arrays."""
    return h % m, h * _ODD % _PRIME % m


def pair_filter(rows: DataFrame, least: int, most_bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap (bytes) of the hashes of all words, pairs and triples of words that occur at least ``least`` times in a language."""
    counted = rows.mapInArrow(_count_pairs, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = written(counted.where(F.col("n") >= least).select("h"), "pairs")
    m = PART_BITS
    while m < min(most_bits, 16 * often.count()):
        m *= 2
    place = often.select(F.explode(F.array(*[p.cast("long") for p in _places(F.col("h"), m)])).alias("p")).select((F.col("p") + 1).alias("p"))
    parts = place.groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(m // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():  # at most most_bits / 8 bytes
        at = (r["part"] - 1) * (PART_BITS // 8)
        out[at: at + PART_BITS // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _known(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), dtype=bool)
    for p in _places(h, U(len(bits) * 8)):
        p = p.astype(np.int64)
        ok &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return ok


WINDOW = [f"w{k}" for k in range(1, LONGEST + 1)]
_WINDOWS = "lang string, " + ", ".join(f"{w} string" for w in WINDOW) + ", n long"


def _lead_windows(bits):
    def run(batches):
        known = bits.value
        for batch in batches:
            code = batch.column("code").to_numpy(zero_copy_only=False).view(U)
            for i, j, data, at in tokens.walk(batch.column("text")):
                s, e, row, h, joined = _words(data, at)
                if not len(s):
                    continue
                own = code[i + row]
                joined &= _known(_pair_hash(h, own), known)
                triple = joined & _after(joined, 1) & _known(_triple_hash(h, own), known)
                lead = _known(_word_hash(h, own), known)
                # whether a window reaches its second, third and fourth word
                reach = [lead & joined, lead & triple, lead & triple & _after(triple, 1)]
                _, first, word = np.unique(h, return_index=True, return_inverse=True)
                lower = tokens.LOWER[data].tobytes()
                text = pa.array(["", *[lower[s[k]: e[k]].decode() for k in first]])
                langs = batch.column("lang").slice(i, j - i).dictionary_encode()
                lang = langs.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64)
                cols = [np.where(lead, word + 1, 0), *[np.where(ok, np.roll(word, -k) + 1, 0) for k, ok in enumerate(reach, 1)]]
                order = np.lexsort([*cols[::-1], lang])
                keys = [c[order] for c in (lang, *cols)]
                new = np.ones(len(order), dtype=bool)
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in keys])
                start = np.flatnonzero(new)
                n = np.diff(np.append(start, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(keys[0][start])), *[text.take(pa.array(c[start])) for c in keys[1:]], pa.array(n)],
                    names=["lang", *WINDOW, "n"])

    return run


def phrase_counts(df: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, f) of all phrases of 1 to LONGEST words that occur at least ``least`` times, and the number of
    words of each language as its phrase of size 0."""
    spark = df.sparkSession
    rows_per_batch(spark)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    rows = df.select(lang.alias("lang"), F.xxhash64(lang).alias("code"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    bits = spark.sparkContext.broadcast(pair_filter(rows, least))
    longest = rows.mapInArrow(_lead_windows(bits), _WINDOWS).groupBy("lang", *WINDOW).agg(F.sum("n").alias("n"))
    # one condition on the count, which stays above the sum, so that both parts read the same shuffle
    whole = longest.where(F.when(F.col(WINDOW[-1]) != "", F.col("n")).otherwise(F.lit(0)) >= least).select(
        "lang", F.lit(LONGEST).alias("size"), F.array_join(F.array(*WINDOW), " ").alias("phrase"), F.col("n").alias("f"))
    # shorter phrases: the sums over all windows that begin with them
    shorter = WINDOW[:-1]
    summed = longest.rollup("lang", *shorter).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    size = F.lit(len(shorter)) - F.length(F.bin("g")) * (F.col("g") > 0).cast("int")
    summed = summed.withColumn("size", size).where((F.col("size") == 0) | (F.col("size") > 0) & (F.col("f") >= least))
    summed = summed.withColumn("words", F.filter(F.array(*shorter), lambda w: w.isNotNull() & (w != "")))  # pads are empty, summed-over words null
    summed = summed.where(F.size("words") == F.col("size")).select("lang", "size", F.array_join("words", " ").alias("phrase"), "f")
    return summed.unionByName(whole)


def _exact(c: str):
    return F.col(c).cast("decimal(20,0)")


def collocations(df: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases of 2 to LONGEST words: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, l and r those of its parts at the cut of lowest score floor(2000000 a / (l + r)), n the words of
    the language. A phrase within a longer one that has ``percent`` of its count or more is left out.
    """
    known = written(phrase_counts(df, least, text_col, lang_col), "phrases")
    of = known.where("size > 0").select("lang", "phrase", "f")
    cand = known.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    cuts = cand.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        of.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumns({"top": _exact("a") * 2000000, "sum": _exact("l") + _exact("r")})
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("top div sum").alias("score"), "k", "l", "r")).alias("cut"))
    places = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    inner = cand.where("size > 2").select("lang", F.explode(places).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(
        F.max("longer").alias("longer"))
    held = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * percent))
    held = held.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = held.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    n = known.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
