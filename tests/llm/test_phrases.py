"""Phrase mining against a plain-Python count of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import phrases
from tests.llm import brute

KIND = "text string, lang string, n long, phrase string, w1 string"


def table(spark, rows):
    return spark.createDataFrame([(t, g, 1, "x", "y") for t, g in rows], KIND)


def plain(rows, least, top, percent=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(brute.LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i: i + k])] += 1
    often = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, w), a in often.items():
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if not any(g == lang and len(x) > len(w) and 100 * b >= percent * a and any(x[i: i + len(w)] == w for i in range(len(x))) for (g, x), b in often.items()):
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(ranked)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus():
    rng = random.Random(4)
    vocab = ["the", "of", "a", "Ünder", "naïve", "x y", "new york", "in the end", "ÉCOLE", "z"]
    rows = []
    for i in range(220):
        words = " ".join(rng.choice(vocab) if rng.random() < 0.8 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 30)))
        rows.append((re.sub(" ", lambda m: rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ". "]), words), rng.choice(["en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", "fr"), (" ,;. ", "fr"), ("alone", "xx"), ("big deal of the day " * 3000, "long")] + [("same line here again", "en")] * 40


@pytest.mark.parametrize("least,top", [(30, 2000), (5, 7), (2, 2000)])
def test_collocations_match_plain_python(spark, least, top):
    rows = corpus()
    assert rows_of(phrases.collocations(table(spark, rows).repartition(5), least, top)) == plain(rows, least, top)


def test_empty_tables_and_texts(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [(None, None), ("", "en"), ("one", "en")]), 1).count() == 0


def test_full_bitmap_gives_the_same(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(phrases, "pair_filter", lambda *a: np.full(4096, 255, dtype=np.uint8))  # no pair is ruled out
    assert rows_of(phrases.collocations(table(spark, rows), 5)) == plain(rows, 5, 2000)


def test_filter_knows_frequent_words_and_pairs_only(spark):
    df = table(spark, [("a b a b a b", "en"), ("a c", "en"), ("a b", "fr")])
    rows = df.select("text", "lang", F.xxhash64("lang").alias("code"))
    bits = lambda least: bin(int.from_bytes(phrases.pair_filter(rows, least).tobytes(), "little")).count("1")
    assert 4 <= bits(3) <= 6 and bits(4) in (1, 2) and bits(5) == 0  # in English: a, b and a b; a; nothing; no triple occurs three times


def test_marginals_are_counts_of_all_phrases(spark):
    got = {(r["lang"], r["size"], r["phrase"]): r["f"] for r in phrases.phrase_counts(table(spark, [("a b c d e. a b", "en"), ("a b", "en")]), 1).collect()}
    assert got["en", 0, ""] == 9 and got["en", 2, "a b"] == 3 and got["en", 4, "b c d e"] == 1 and got["en", 1, "e"] == 1
    assert ("en", 4, "c d e") not in got and len(got) == 1 + 5 + 4 + 3 + 2
