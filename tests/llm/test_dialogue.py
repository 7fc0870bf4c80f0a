"""Conversation repair against exhaustive edits and a plain-Python version of the whole operator."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from larder.llm import dialogue

LANGUAGE = re.compile("(s?(ua)+)?")
INSERTS = ["", "u", "a", "ua", "au"]


def exhaustive(symbols):
    """Least (cost, audit) over every edit of every row and up to two inserted turns in every gap."""
    choices = []
    for x in symbols:
        cut = int(x.isupper())
        row = [(3, "D", "")]
        if x != "d":
            row += [(cut, "K", x.lower())] + [(2 + cut, "R", c) for c in "ua"]
        choices += [[(2 * len(g), "I" * len(g), g) for g in INSERTS], row]
    choices.append([(2 * len(g), "I" * len(g), g) for g in INSERTS])
    return min((sum(c[0] for c in pick), "".join(c[1] for c in pick)) for pick in product(*choices) if LANGUAGE.fullmatch("".join(c[2] for c in pick)))


def test_cells_match_exhaustive_edits():
    for n in (0, 1, 2):
        for symbols in product("suaxSUAXd", repeat=n):
            assert dialogue.cheapest(dialogue.parse("".join(symbols))) == exhaustive(symbols), symbols
    rng = random.Random(3)
    for _ in range(12):
        symbols = "".join(rng.choice("suaxSUAXd") for _ in range(3))
        assert dialogue.cheapest(dialogue.parse(symbols)) == exhaustive(symbols), symbols


def all_splits(symbols):
    """The textbook table: every span, every split point."""
    n = len(symbols)
    cell = {(i, i + 1): dict(dialogue.lexical(symbols[i])) for i in range(n)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            options = [x for k in range(i + 1, i + size) for x in dialogue.combine(cell[i, k], cell[k, i + size]).items()]
            cell[i, i + size] = dialogue._least(options)
    return cell[0, n]


def test_one_split_point_is_as_good_as_all():
    rng = random.Random(5)
    for n in (5, 17, 33):
        symbols = "".join(rng.choice("suuaaaxSUAd") for _ in range(n))
        assert dialogue.parse(symbols) == all_splits(symbols)


def plain(rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)} of damaged rows, by states from left to right."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), turn, text))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: r[:4])
        seen, kinds, faults = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, _, role, _, _, text in own:
            body = text.rstrip(" \t\n\x0b\f\r")
            f = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[f] = faults.get(f, 0) + 1
            kinds.append((role[:1], f))
        best = {"0": (0, "")}
        hops = {"0": {"0": "", "U": "I", "A": "II"}, "S": {"S": "", "U": "I", "A": "II"}, "U": {"U": "", "A": "I"}, "A": {"A": "", "U": "I"}}
        step = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}

        def close(b):
            new = {}
            for p, (c, a) in b.items():
                for q, i in hops[p].items():
                    new[q] = min(new.get(q, (1 << 60, "")), (c + 2 * len(i), a + i))
            return new

        best = close(best)
        for c0, f in kinds:
            new = {}
            for p, (c, a) in best.items():
                ways = [(p, 3, "D")]
                if f not in ("b", "d"):
                    ways += [(step[p, x], (0 if e == "K" else 2) + (f == "t"), e) for e, x in (("K", c0), ("R", "u"), ("R", "a")) if (p, x) in step and (e == "R" or c0 in "sua")]
                for q, d, e in ways:
                    new[q] = min(new.get(q, (1 << 60, "")), (c + d, a + e))
            best = close(new)
        cost, audit = min(best[q] for q in "0A" if q in best)
        said, rest = [], iter(own)
        system = 0
        for e in audit:
            r = next(rest) if e != "I" else None
            if e == "D":
                continue
            if not said and e == "K" and r[2][0] == "s":
                system = 1
            said.append((r[2] if e == "K" else ("user", "assistant")[(len(said) - system) % 2]) + ":" + (r[5] if r else ""))
        turns = [r[4] for r in own if r[4] is not None]
        pairs = [a[0] + b[0] for a, b in zip(kinds, kinds[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["b"], faults["d"], faults["t"],
                     sum(x not in ("su", "ua", "au") for x in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h:
            out += [(conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (2 if h == 3 else 1)
    return out


KIND = "conv_id long, turn long, role string, text string, audit string, cost string, conv int"


def report(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], KIND)
    return {r["conv_id"]: tuple(r)[1:] for r in dialogue.repair(df, dialogue.damaged(df)).collect()}


def wanted(rows):
    blank = (0, 0, 0, 0, 0, 0, "", dialogue.EMPTY)
    return {c: blank for c, *_ in rows} | plain(damage(rows))


def odd_rows():
    rng = random.Random(8)
    texts = ["Fine.", "cut off", " \t", "", None, "What? ", "Same!", "Same!", "été.\n", "x " * 30000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(rng.randrange(30), rng.choice([None, *range(9)]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)) for _ in range(260)]
    rows += [(None, k, "user", "No conversation.") for k in (1, 2, 2, None)] + [(77, None, "user", "One."), (78, 2**62, "system", "Far.")]
    return rows + rows[:20]  # repeated rows, ties of turns


@pytest.mark.parametrize("rows", [odd_rows(), [], [(5, 0, "user", "Hi.")]])
def test_repair_matches_plain_python(spark, rows):
    assert report(spark, rows) == wanted(rows)


def test_a_conversation_of_many_partitions(spark):
    rng = random.Random(1)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"{k % 700} {'.' if k % 3 else ''}") for k in range(3000)] + [(1, 5000, "user", "Again.")] * 400 + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], KIND).repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the stretches stay apart
    try:
        assert report(spark, rows) == wanted(rows)
        assert dialogue.repair(df, dialogue.damaged(df)).count() == 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_repaired_turns_form_the_language(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = dialogue.damaged(df)
    made = dialogue.repaired_turns(turns, dialogue.audits(turns)).orderBy("conv", "place").collect()
    by = {}
    for r in made:
        assert r["place"] == len(by.setdefault(r["conv"], ""))
        by[r["conv"]] += r["role"][0]
    assert by and all(LANGUAGE.fullmatch(x) for x in by.values())
    assert turns.select(F.count_distinct("conv")).first()[0] >= len(by)
