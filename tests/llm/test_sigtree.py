"""Signature trees against all pairs."""

import random

import numpy as np
import pytest

from larder.llm import neardup, sigtree
from tests.llm import brute

KIND = "doc_id long, text string, n_shingles string, component_id string, bits string"


def links(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], KIND)
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in sigtree.jaccard_components(df, **kw).collect()]


def family(rng, words, copies, edits, first, vocab):
    base = [rng.choice(vocab) for _ in range(words)]
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = rng.choice(vocab)
        out.append((first + k, " ".join(w)))
    return out


@pytest.mark.parametrize("block,room", [(sigtree.BLOCK, sigtree.ROOM), (5, 1)])
def test_components_match_all_pairs(spark, monkeypatch, block, room):
    monkeypatch.setattr(sigtree, "BLOCK", block)  # also every bucket in several nodes, one pair a component in the first walk
    monkeypatch.setattr(sigtree, "ROOM", room)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    rows = family(rng, 150, 60, 6, 1000, vocab) + family(rng, 60, 40, 3, 5000, vocab) + family(rng, 400, 12, 20, 100, vocab)
    rows += [(8000 + i, passage + " " + " ".join(rng.choice(vocab) for _ in range(12 + i))) for i in range(60)]
    rows += [(9000 + i, passage) for i in range(30)] + [(9900 + i, "one two" if i % 2 else "one") for i in range(4)]
    rng.shuffle(rows)
    want = brute.near_duplicates(dict(rows), 3, 90)
    got = links(spark, rows)
    assert {i: c for i, _, c in got} == want
    assert {i: n for i, n, _ in got} == {i: len(brute.shingles(t, 3)) for i, t in rows}
    assert 1 < len(set(want.values())) < len(rows)


@pytest.mark.parametrize("few", [1, 64])
def test_pairs_are_counted_before_they_meet_in_trees(spark, monkeypatch, few):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    quotes = [text(40) for _ in range(90)]
    # unlike texts, every passage in four of them, two share at most three of twelve
    rows = [(100 + i, " ".join(quotes[3 * ((i + r) % 30) + k] for r in (0, 1, 4, 13) for k in range(3))) for i in range(30)]
    rows += family(rng, 300, 7, 16, 1000, vocab) + family(rng, 40, 9, 2, 2000, vocab) + family(rng, 8, 5, 1, 3000, vocab)
    base = text(200).split()
    rows += [(4000 + i, " ".join(base[: 200 - 3 * i])) for i in range(10)]  # sets inside one another
    held, before = [], sigtree.written

    def keep(df, name, *a):
        out = before(df, name, *a)
        if name == "placed":
            held.append({r["id"] for r in out.select("id").distinct().collect()})
        return out

    monkeypatch.setattr(sigtree, "FEW", few)
    monkeypatch.setattr(sigtree, "written", keep)
    assert {i: c for i, _, c in links(spark, rows)} == brute.near_duplicates(dict(rows), 3, 90)
    assert any(100 <= i < 130 for i in held[0]) == (few == 1)  # they meet too rarely for a link and enter no tree


def test_odd_rows(spark):
    assert links(spark, []) == []
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (4, "e f g h"), (3, "e f g h"), (6, "x y " * 60000), (7, "x y " * 60000 + "x"), (8, "A  B\nC d")]
    got = links(spark, rows)
    assert len(got) == len(rows)
    assert {i: c for i, _, c in got} == {None: None, 1: 1, 2: 2, 3: 3, 4: 3, 6: 6, 7: 6, 8: 3}


def members(rng, groups, size):
    out, k = [], 0
    for g in range(groups):
        base = rng.choice(2**63, size=size + 7 * g, replace=True).astype(np.uint64)
        for _ in range(9):
            v = base.copy()
            at = rng.choice(len(v), size=rng.integers(0, len(v) // 8 + 1), replace=False)
            v[at] = rng.choice(2**63, size=len(at)).astype(np.uint64)
            out.append((k, np.unique(v)))
            k += 1
    return out


@pytest.mark.parametrize("size", [9, 60, 700])
def test_walk_rules_out_no_link(size):
    rng = np.random.default_rng(size)
    sets = members(rng, 6, size)
    root = sigtree.tree([(i, len(v), i, sigtree.bitmap(v)) for i, v in sets])
    named = {(min(x.id, y.id), max(x.id, y.id)) for _, x, y in sigtree.walk(root, root, 90)}
    of = dict(sets)
    linked = {(a, b) for a in of for b in of if a < b and 100 * (n := len(np.intersect1d(of[a], of[b]))) >= 90 * (len(of[a]) + len(of[b]) - n)}
    assert linked <= named and len(named) < len(of) * (len(of) - 1) // 2
    one = sigtree.tree([(i, len(v), 0, sigtree.bitmap(v)) for i, v in sets])
    assert not list(sigtree.walk(one, one, 90))  # one component is left at the root


def test_folded_bitmaps():
    v = np.random.default_rng(1).choice(2**63, size=500).astype(np.uint64)
    raw = sigtree.bitmap(v)
    bits, m = int.from_bytes(raw, "little"), 8 * len(raw)
    assert 8 * 500 <= m < 16 * 500
    for to in (m, m // 2, 64):
        assert sigtree.fold(bits, m, to) == sum({1 << (int(x) % to) for x in v})


def test_prefixes_of_linked_sets_meet():
    rng = random.Random(2)
    for n in range(1, 60):
        base = list(range(n))
        for _ in range(20):
            x = set(rng.sample(base, max(1, n - rng.randrange(4)))) | {rng.randrange(1000, 1010) for _ in range(rng.randrange(3))}
            y = set(rng.sample(base, max(1, n - rng.randrange(4))))
            if 100 * len(x & y) >= 90 * len(x | y):
                assert set(sorted(x)[: sigtree.prefix_length(len(x), 90)]) & set(sorted(y)[: sigtree.prefix_length(len(y), 90)])


def test_sets_are_those_of_near_duplicates():
    assert [len(x) for x in neardup.sets(["a b c d", "a"], 3)] == [2, 1]
