"""Vector search, language model, classifiers, page text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import ann, htmltext, lm, quality, toxicity
from tests.llm import brute

VEC = "vec_id long, embedding array<float>, rank string, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], VEC)


def exact(rows, every, k):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            s = sorted((-(x * y).sum(), i) for i, y in ok if i != q)[:k]
            out[q] = [(i, -d) for d, i in s]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_search_is_exact_when_all_leaves_are_seen(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)] + [(i, [1.0] * 8) for i in range(600, 1000)]  # a hot vector: ties
    rows += [(1001, None), (1002, [0.0] * 8), (1003, [math.nan] + [1.0] * 7), (1004, [None] + [1.0] * 7), (1005, [math.inf] * 8), (1020, [1.0] * 3), (None, [1.0] * 8)]
    want = exact([r for r in rows if r[1] is None or len(r[1]) == 8], 20, 20)
    got = found(ann.nearest(vectors(spark, rows), target_recall=1.0, branching=4, depth=2, bin_rows=50))
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.97  # calibrated on probes, not on these queries
    index = ann.Index(vectors(spark, rows), branching=4, depth=2, bin_rows=50)
    whole = found(index.search(index.rows.where(F.col("id") % 20 == 0).select("id", "v"), 20, index.tree.n_leaves, query_block=7))
    for q in want:
        assert [i for i, _ in whole[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in whole[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)
    assert max(parts for _, parts in index.bins.values()) > 1  # the hot leaf is split


def test_search_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, got = exact(rows, 20, 20), found(ann.nearest(df))
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_search_small_tables(spark):
    assert ann.nearest(vectors(spark, [])).count() == 0
    assert ann.nearest(vectors(spark, [(20, None)])).count() == 0
    assert ann.nearest(vectors(spark, [(20, [1.0, 2.0])])).count() == 0
    got = found(ann.nearest(vectors(spark, [(20, [1.0, 2.0]), (3, [1.0, 1.0]), (20, [5.0, 5.0]), (4, [1.0, 1.0])])))
    assert got == {20: [(3, 3.0), (4, 3.0)]}


# ---- language model ----------------------------------------------------------------

def test_filter_never_reads_too_low_and_seldom_too_high():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 40000).astype(np.uint64)
    counts = rng.zipf(1.5, 40000).clip(1, 10**6)
    want = lm.level(counts)
    shard = lm.Shard(4, 0, [b""] * 16, np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    pieces = []
    for s in range(16):
        mine = (keys >> np.uint64(60)) == s
        pieces.append(lm.filter_bits(keys[mine], want[mine]).tobytes())
    shard = lm.Shard(4, 0, pieces, np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    got = np.zeros(len(keys), dtype=np.uint8)
    shard.levels(keys, got)
    assert (got >= want).all() and (got > want).mean() < 0.05
    other = np.zeros(40000, dtype=np.uint8)
    shard.levels(rng.integers(0, 1 << 63, 40000).astype(np.uint64), other)
    assert (other > 0).mean() < 0.05


def test_levels():
    assert lm.level(np.array([0, 1, 2, 3, 100])).tolist()[:4] == [0, 1, 2, 3]
    assert all(abs(lm.COUNT_OF[lm.level(np.array([c]))[0]] / c - 1) < 0.15 for c in range(1, 5000))


@pytest.mark.parametrize("shard_bytes", [1 << 27, 1 << 12])
def test_scores(spark, sf, shard_bytes):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit("x").alias("score"))
    odd = spark.createDataFrame([(None, "the"), (100001, None), (100002, ""), (100003, "zzzz-never-seen"), (100003, "x " * 30000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    docs = docs.unionByName(odd)
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = [(r["doc_id"], r["text"], brute.words(r["text"]) + [None]) for r in rows]
    c = Counter(x for i, _, w in toks if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)) for i, _, w in toks)
    got = lm.score_documents(docs, shard_bytes=shard_bytes).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(-1e9 < r["score"] < 0 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better than single words on unseen texts


def test_scores_of_empty_tables(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- classifiers -------------------------------------------------------------------

def auc(rows):
    ones, zeros = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("fn,label,folds,fold,least", [(quality.score_quality, "quality", 4, 2, 0.95), (toxicity.score_toxicity, "toxic", 3, 1, 0.8)])
def test_held_out_accuracy(spark, sf, fn, label, folds, fold, least):
    sf = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = fn(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in got)
    y = {r["doc_id"]: r[label] for r in labels.collect()}
    assert auc([(y[r["doc_id"]], r["score"]) for r in got if r["held_out"] and r["doc_id"] in y]) >= least


@pytest.mark.parametrize("fn,label", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifier_odd_rows(spark, fn, label):
    texts = ["you idiot scum and pathetic clown of the worst kind", "a calm and pleasant text on gardens and rivers"]
    rows = [(i, texts[i % 2] + f" {i}") for i in range(60)] + [(None, "idiot"), (100, None), (101, ""), (101, "x " * 20000), (5, texts[0])]
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(i, (i + 1) % 2, i % 2) for i in range(60)] + [(3, 1, 1), (None, 1, 1), (7, None, None), (8, 5, 5), (999, 1, 0)], "doc_id long, toxic int, quality int")
    got = fn(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert fn(docs.limit(0), labels).count() == 0 and fn(docs, labels.limit(0)).where("score > 0").count() == 0
    if label == "toxic":
        kept = toxicity.reject_toxic(docs, labels)
        assert kept.columns == docs.columns and kept.count() <= len(rows)


def test_typical_beginnings_ignore_copies():
    toxic = [f"w{i} idiot w{i + 1} calm" .encode() for i in range(40)] + [b"copied phrase repeated"] * 40
    ordinary = [f"w{i} calm w{i + 1}".encode() for i in range(80)]
    stems = toxicity.typical(toxic, ordinary)
    assert any(b" idiot".startswith(s) for s in stems) and not any(s.startswith((b" cop", b" phr", b" rep", b" calm")) for s in stems)


# ---- pages -------------------------------------------------------------------------

PAGE = ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body class='has-sidebar'>"
        "<nav><a href='/'>menu one</a></nav><div class=\"ad\">buy now</div>%s<div id='comments'>reader words</div><footer>&copy; host</footer></body></html>")


@pytest.mark.parametrize("body,want", [
    ("<article><h1>Head</h1><p>One<br>two &amp; <i>th</i>ree<aside>no</aside><p> four \n five<form>f</form></article>", "Head One two & three four five"),
    ("<main><div class='cookie-notice'>c</div><ul><li>a<li>b</ul><table><tr><td>x</td><td>y</td></tr></table></main>", "a b x y"),
    ("<article></article>", ""), ("<article>&lt;b&gt; caf&eacute; &#8364; a &am</article>", "<b> café € a &am"),
    ("<article>cut in a tag <a href=\"", "cut in a tag"), ("<ARTICLE>A<!-- x --><P CLASS=advert>B</P>C</ARTICLE>", "A C"),
])
def test_main_text(body, want):
    page = PAGE % body if not body.endswith('"') else PAGE.split("%s")[0] + body  # a page that ends in a tag
    text = " ".join(t for r, t in htmltext.blocks(page) if r == "main")
    assert text == want


def test_suffix_classes_match_counting():
    rng = np.random.default_rng(8)
    streams = [rng.integers(0, 3, n).astype(np.uint64) for n in (0, 3, 10, 40, 40, 2, 2)]
    streams[5] = streams[6] = np.array([1, 2], dtype=np.uint64)
    run = 5
    at, cls, block = htmltext.suffix_classes(streams, run)
    key = lambda b, p: tuple(streams[b][p: p + run].tolist())
    whole = [(b, p) for b, s in enumerate(streams) for p in range(max(len(s) - run + 1, len(s) > 0))]
    assert sorted(zip(block.tolist(), at.tolist())) == whole
    groups, want = {}, {}
    for b, p, c in zip(block.tolist(), at.tolist(), cls.tolist()):
        groups.setdefault(c, set()).add((b, p))
    for b, p in whole:
        want.setdefault(key(b, p), set()).add((b, p))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("group_pages", [1, 3, 2000])
def test_pages_without_landmarks(spark, group_pages):
    shared = "these words come on every page of this host and mean nothing"
    page = lambda i: f"<body><div>{shared} </div><div>page {i} has words of its own: alpha{i} beta{i} gamma{i}</div><div>{shared}</div></body>"
    rows = [(i, "https://U@Host.example:80/x", page(i)) for i in range(8)] + [(100, "https://other.example/", page(1)), (101, None, page(2)), (None, "https://host.example/", page(50)),
                                                                             (102, "u", None), (103, "u", ""), (104, "https://host.example/", "<article>kept " + shared + "</article>"), (7, "https://host.example/", page(7))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in htmltext.main_text(df, group_pages=group_pages).collect()]
    own = lambda i: f"page {i} has words of its own: alpha{i} beta{i} gamma{i}"
    want = [(i, own(i)) for i in range(8)] + [(7, own(7)), (None, own(50)), (102, ""), (103, ""), (104, "kept " + shared)]
    want += [(100, re.sub(r"<[^>]+>", " ", page(1))), (101, re.sub(r"<[^>]+>", " ", page(2)))]
    norm = lambda x: sorted((str(i), " ".join(t.split())) for i, t in x)
    assert norm(got) == norm(want)
    assert htmltext.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("group_pages", [1, 2000])
def test_copied_articles_and_short_blocks_are_kept(spark, group_pages):
    shared = "these words come on every page of this host and mean nothing"
    story = "a story of more than eight words that two pages of the host both carry in full"
    own = lambda i: f"page {i} has words of its own: alpha{i} beta{i} gamma{i}"
    copied = f"<h1>Summary</h1><p>{story}</p><p>So it ends.</p>"
    rows = [(i, f"<body><nav>to page {i}</nav>{copied}</body>") for i in (1, 2, 3)]
    rows += [(i, f"<body><h1>Summary</h1><p>{own(i)}</p><p>{shared}</p><p>Read on</p><p>More</p></body>") for i in (4, 5)]
    df = spark.createDataFrame([(i, "https://h.example/", t) for i, t in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(df, group_pages=group_pages).collect()}
    assert got == {i: f"Summary {story} So it ends." for i in (1, 2, 3)} | {i: f"Summary {own(i)}" for i in (4, 5)}


@pytest.mark.parametrize("group_pages", [1, 3, 2000])
def test_suffix_arrays_decide_inside_landmarks(spark, group_pages):
    notice = "subscribers of this site get two free mugs with every order placed before Friday"
    quote = "a line of ten words or more that three pages quote in full"
    copy = "one story in many words that nearly all pages of this second host carry with one word of theirs at the end"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    page = lambda i: f"<nav>menu</nav><article><p>{own(i)}</p><div>{notice}</div><p>Read on</p><p>{quote if i < 3 else ''} end{i}</p></article>"
    rows = [(i, "https://a.example/", page(i)) for i in range(7)] + [(6, "https://a.example/", page(6)), (None, "https://a.example/", page(50))]
    rows += [(7, "https://a.example/", f"<main>{own(7)}</main>"), (8, "https://a.example/", f"<main>{own(7)}</main>")]
    rows += [(20 + i, "https://b.example/", f"<article>{copy} c{i}</article>") for i in range(6)]
    rows += [(30 + i, "https://c.example/", f"<article><p>{own(i)}</p><p>{notice}</p></article>") for i in range(3)]  # too few to tell
    rows += [(40 + i, "https://d.example/", f"<article><p>{own(40 + i % 2)}</p><p>{notice}</p></article>") for i in range(8)]  # two articles, copied
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["text"]) for r in htmltext.main_text(df, group_pages=group_pages).collect())
    text = lambda i: " ".join(f"{own(i)} {quote if i < 3 else ''} end{i}".split())
    want = [(i, text(i)) for i in range(7)] + [(6, text(6)), (None, text(50)), (7, own(7)), (8, own(7))]
    want += [(20 + i, f"{copy} c{i}") for i in range(6)] + [(30 + i, f"{own(i)} {notice}") for i in range(3)] + [(40 + i, f"{own(40 + i % 2)} {notice}") for i in range(8)]
    assert got == sorted((str(i), t) for i, t in want)


def test_a_very_long_text_does_not_end_the_sample(spark):
    from larder.llm.common import labelled_sample
    rows = [(i, ("word " * (2000 if i < 6 else 3)), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    few, known = labelled_sample(docs, labels, "doc_id", "text", "toxic", 10, 10, 60, 2000)
    assert sorted(r["id"] for r in few.collect()) == list(range(6, 60)) and known == {0: 30, 1: 30}
    long = docs.where("doc_id % 2 = 0 OR doc_id < 6")  # of class 1 only texts that do not fit
    few, _ = labelled_sample(long, labels, "doc_id", "text", "toxic", 10, 10, 60, 2000)
    assert [r["label"] for r in few.collect()].count(1) == 1
