"""Repair of conversations by weighted CYK interval parsing.

A repaired conversation has the role initials ``(s?(ua)+)?``. The automaton of that language has the states
``0`` (nothing read), ``S``, ``U`` and ``A`` (last turn system, user, assistant); ``0`` and ``A`` accept. The repair grammar in
Chomsky normal form has one nonterminal [p, q] per state pair, the binary rules [p, q] -> [p, r] [r, q] and one lexical
rule per row and edit: keep (0), reroll to user or assistant (2), delete (3); a truncated row that stays costs 1 more, and
blank or duplicate rows can only be deleted. Inserted turns (2 each) derive from no row at all; their closure is multiplied
into every lexical cell. A span's cell holds the minimum (cost, audit) of each nonterminal, audit being the edits' initials
D, I, K, R in order. Cells are combined bottom-up by span length 1, 2, 4, ...: the binary rules are associative, so one split
point per span derives what all split points do, and of equal cost no audit is a prefix of another, so the least audit of a
span is made of the least audits of its parts.

Rows of one conversation may lie in many partitions (they are dealt by range, not by key): each partition parses its
stretch, and the cells of the stretches are combined afterwards. Equal rows are counted before any shuffle, texts travel as
digests until the edits are known, and then stream past once.

Order of rows: turn, nulls first, then role, then the SHA-256 of the text. A null role or text reads as one space, rows
without a conversation id are one conversation of their own, a role that begins with none of s, u, a can only be rerolled or
deleted. Repeated rows are duplicates of the first. An empty table gives no rows; columns beside the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby, product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larder.llm.common import written

SPACE = " \t\n\x0b\f\r"
ENDS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: What a role does to the state: (state before, state after).
MOVES = {"s": [("0", "S")], "u": [("0", "U"), ("S", "U"), ("A", "U")], "a": [("U", "A")]}
STATES = "0SUA"
MEMO = 16  # cells of spans up to this length are remembered

Cell = dict[tuple[str, str], tuple[int, str]]


def _least(options: Iterable[tuple[tuple[str, str], tuple[int, str]]]) -> Cell:
    cell: Cell = {}
    for pq, x in options:
        if pq not in cell or x < cell[pq]:
            cell[pq] = x
    return cell


def combine(left: Cell, right: Cell) -> Cell:
    """The binary rules: the cell of a span from those of its two parts."""
    return _least(((p, q), (c + d, x + y)) for ((p, r), (c, x)), ((t, q), (d, y)) in product(left.items(), right.items()) if r == t)


def _closure() -> Cell:
    """Inserted turns only: the cheapest way from state to state."""
    cell = {(p, p): (0, "") for p in STATES}
    step = cell | {pq: (INSERT, "I") for c in "ua" for pq in MOVES[c]}
    for _ in STATES:
        cell = combine(cell, step)
    return cell


NOTHING = _closure()


@lru_cache(maxsize=None)
def lexical(symbol: str) -> tuple:
    """Cell of one row: s, u, a or x by its role, upper case when truncated, d when it must go."""
    options = [((p, p), (DELETE, "D")) for p in STATES]
    if symbol != "d":
        extra = CUT * symbol.isupper()
        options += [(pq, (KEEP + extra, "K")) for pq in MOVES.get(symbol.lower(), ())]
        options += [(pq, (REROLE + extra, "R")) for c in "ua" for pq in MOVES[c]]
    return tuple(combine(combine(NOTHING, _least(options)), NOTHING).items())


@lru_cache(maxsize=1 << 16)
def _short(symbols: str) -> tuple:
    if len(symbols) == 1:
        return lexical(symbols)
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return tuple(combine(dict(_short(symbols[:half])), dict(_short(symbols[half:]))).items())


def parse(symbols: str) -> Cell:
    """Cell of a whole stretch of rows, spans of doubling length."""
    cells = [dict(_short(symbols[i: i + MEMO])) for i in range(0, len(symbols), MEMO)] or [NOTHING]
    while len(cells) > 1:
        cells = [combine(*cells[i: i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of the conversation a cell spans."""
    return min(cell["0", q] for q in "0A" if ("0", q) in cell)


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


# ---- damage -------------------------------------------------------------------------

def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) with faults planted by crc32 of ``conv:turn`` modulo 20, a null there being one space.

    0 drops the row, 1 empties its text, 2 takes out its ends of sentences, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv, turn)])
    d = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
                  F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h")).where("h <> 0")
    t, h = F.col("text"), F.col("h")
    return d.select("conv", "turn", F.when(h == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(h == 1, F.lit("")).when(h == 2, F.translate(t, "".join(ENDS), "")).otherwise(t).alias("text"),
                    F.explode(F.array_repeat(F.lit(1), F.when(h == 3, 2).otherwise(1))).alias("one")).drop("one")


# ---- faults and symbols -------------------------------------------------------------

def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _counted(turns: DataFrame) -> DataFrame:
    """Equal rows as one with their number, their faults and symbol: no text."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    rows = turns.select("conv", "turn", "role", _digest(F.col("text")).alias("digest"), (body == "").alias("blank"),
                        (~F.right(body, F.lit(1)).isin(*ENDS)).alias("cut"), F.when(initial.isin(*MOVES), initial).otherwise("x").alias("initial"))
    rows = rows.groupBy("conv", "turn", "role", "digest", "blank", "cut", "initial").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy("conv", "role", "digest").agg(F.min(place).alias("first")).select(
        F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("g"), "first")
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("g")))
    fresh = (~F.col("blank") & place.eqNullSafe(F.col("first"))).cast("int")
    symbol = F.when(fresh == 0, "d").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    return rows.select("conv", "turn", "role", "digest", "n", "initial", symbol.alias("symbol"), (F.col("blank").cast("int") * F.col("n")).alias("blank"),
                       F.when(F.col("blank"), 0).otherwise(F.col("n") - fresh).alias("duplicate"), (fresh * F.col("cut").cast("int")).alias("truncated"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conv, its rows) one after the other; rows of a conversation are adjacent."""
    return groupby((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["conv"])


_CELLS = "array<struct<p string, q string, cost bigint, audit string>>"


def _in_batches(rows: Iterator[dict], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema)


def _parse_stretches(kind: pa.DataType):
    cells = pa.list_(pa.struct([("p", pa.string()), ("q", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
    schema = pa.schema([("conv", kind), ("stretch", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("cells", cells)])

    def stretches(batches):
        for conv, rows in _runs(batches):
            symbols, illegal, first, last = [], 0, None, None
            for r in rows:
                symbols.append(r["symbol"] + "d" * (r["n"] - 1))
                illegal += r["n"] - 1 + (last is not None and not legal(last, r["initial"]))
                first, last = first or r["initial"], r["initial"]
            cell = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in parse("".join(symbols)).items()]
            yield {"conv": conv, "stretch": TaskContext.get().partitionId(), "first": first, "last": last, "illegal": illegal, "cells": cell}

    return lambda batches: _in_batches(stretches(batches), schema)


def _combine_stretches(kind: pa.DataType):
    schema = pa.schema([("conv", kind), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])

    def conversations(batches):
        for conv, stretches in _runs(batches):
            whole, illegal, last = NOTHING, 0, None
            for s in stretches:
                whole = combine(whole, {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in s["cells"]})
                illegal += s["illegal"] + (last is not None and not legal(last, s["first"]))
                last = s["last"]
            cost, audit = cheapest(whole)
            yield {"conv": conv, "illegal": illegal, "cost": cost, "audit": audit}

    return lambda batches: _in_batches(conversations(batches), schema)


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv, turn, role, text): conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    rows = _counted(turns)
    kind = rows.schema["conv"].dataType
    faults = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
    order = ["conv", "turn", "role", "digest"]
    stretches = rows.select(*order, "symbol", "initial", "n").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _parse_stretches(to_arrow_type(kind)), f"conv {kind.simpleString()}, stretch int, first string, last string, illegal long, cells {_CELLS}")
    parsed = stretches.repartition("conv").sortWithinPartitions("conv", "stretch").mapInArrow(
        _combine_stretches(to_arrow_type(kind)), f"conv {kind.simpleString()}, illegal long, cost long, audit string")
    got = parsed.withColumnRenamed("conv", "c")
    return faults.join(got, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


# ---- edits --------------------------------------------------------------------------

def _edited(audit: str, rows: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns; the audit fixes the roles, for only a kept row can be the system's."""
    state = "0"
    for edit in audit:
        row = next(rows) if edit != "I" else None
        if edit == "D":
            continue
        role, text = (row["role"], row["text"]) if edit == "K" else ("assistant" if state == "U" else "user", row["text"] if row else "")
        yield edit, role, text
        state = dict(MOVES[role[0]])[state]


def _conversations(batches):
    """(conv, its audit, its rows); the audit comes before the rows."""
    for conv, rows in _runs(batches):
        yield conv, next(rows)["audit"], rows


def _write_turns(kind):
    schema = pa.schema([("conv", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def turns(batches):
        for conv, audit, rows in _conversations(batches):
            for k, (edit, role, text) in enumerate(_edited(audit, rows)):
                yield {"conv": conv, "place": k, "edit": edit, "role": role, "text": text}

    return lambda batches: _in_batches(turns(batches), schema, 64)


def _write_digests(kind):
    schema = pa.schema([("conv", kind), ("repaired_sha256", pa.string())])

    def digests(batches):
        for conv, audit, rows in _conversations(batches):
            h = hashlib.sha256()
            for k, (_, role, text) in enumerate(_edited(audit, rows)):
                h.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            yield {"conv": conv, "repaired_sha256": h.hexdigest()}

    return lambda batches: _in_batches(digests(batches), schema)


def _beside_audits(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, adjacent in one partition."""
    heads = audit.select("conv", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit",
                         F.lit(0).alias("row"), F.lit(b"").alias("digest"))
    body = turns.select("conv", "turn", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("row"), _digest(F.col("text")).alias("digest"))
    both = heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "row", "turn", "role", "digest")
    return both.select("conv", "role", "text", "audit")


def repaired_turns(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv, place (from 0), edit (K, R or I), role, text."""
    both = _beside_audits(turns, audit)
    kind = both.schema["conv"].dataType
    return both.mapInArrow(_write_turns(to_arrow_type(kind)), f"conv {kind.simpleString()}, place long, edit string, role string, text string")


def repaired_digests(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """SHA-256 of the newline-joined ``role:text`` per conversation, hashed as the rows stream past."""
    both = _beside_audits(turns, audit)
    kind = both.schema["conv"].dataType
    return both.mapInArrow(_write_digests(to_arrow_type(kind)), f"conv {kind.simpleString()}, repaired_sha256 string")


EMPTY = hashlib.sha256(b"").hexdigest()


def repair(df: DataFrame, turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation id of ``df``: the faults of ``turns``, the cheapest repair and the digest of its result."""
    audit = written(audits(turns), "audits")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = df.select(F.col(f"`{conv}`").alias("conv")).distinct()
    a, s = audit.withColumnRenamed("conv", "c"), repaired_digests(turns, audit).withColumnRenamed("conv", "d")
    out = every.join(a, F.col("conv").eqNullSafe(F.col("c")), "left").join(s, F.col("conv").eqNullSafe(F.col("d")), "left")
    return out.select(F.col("conv").alias(conv), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
