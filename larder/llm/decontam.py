"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of consecutive benchmark words becomes one pattern of the
automaton. Each text is normalised (A-Z lowered, words by single spaces) and
scanned once; matches are mapped from normalised positions to words and from
there to code points of the original text.

Null texts have no words. Null item ids count as hits but are not listed.
Equal windows of several items are one pattern with several owners; rows that
share an id are scanned each on its own. The patterns are broadcast in parts of
at most ``max_bytes`` (an automaton takes some 24 times its patterns in each worker); one automaton per part, and benchmarks above that size
take further scans instead of a larger broadcast. Empty tables give empty results.
"""

from __future__ import annotations

import re
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.llm import tokens

#: Bytes that belong to words: digits, letters and everything from 0x80 on; A-Z are lowered.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_built: dict[str, ahocorasick.Automaton] = {}

HIT_FIELDS = "n_words long, n_hit long, items array<string>, hit_words array<struct<from:int,to:int>>, spans array<struct<start:int,end:int>>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(text: str | None, size: int) -> list[bytes]:
    w = normal_words((text or "").encode())
    if not w:
        return []
    return [b" ".join(w[i: i + size]) for i in range(max(1, len(w) - size + 1))]


def pattern_parts(benchmark: DataFrame, size: int, max_bytes: int, item_col: str, text_col: str):
    """The windows and their owners, in parts of at most ``max_bytes`` of pattern text each."""
    part: dict[bytes, set] = {}
    used = 0
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{text_col}`"))
    for item, text in rows.toLocalIterator():
        for w in windows(text, size):
            if w not in part:
                if used + len(w) > max_bytes and part:
                    yield part
                    part, used = {}, 0
                part[w] = set()
                used += len(w) + 64
            if item is not None:
                part[w].add(item)
    yield part


def automaton(patterns: dict[bytes, set]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, items in patterns.items():
        a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(items)))
    if patterns:
        a.make_automaton()
    return a


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(text: bytes, a: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set]:
    """(words, merged word ranges hit, owners) of one text."""
    words = normal_words(text)
    if not words or not len(a):
        return len(words), [], set()
    found = list(a.iter(f" {b' '.join(words).decode('latin-1')} "))
    if not found:
        return len(words), [], set()
    ends = np.cumsum([len(w) + 1 for w in words])  # position of the space after each word
    last = np.searchsorted(ends, [e for e, _ in found])
    items = set().union(*(v[1] for _, v in found))
    return len(words), merge([(int(k) - v[0] + 1, int(k) + 1) for k, (_, v) in zip(last, found)]), items


def _scanner(key: str, shared, first: bool):
    def run(batches):
        if key not in _built:
            _built.clear()
            _built[key] = automaton(shared.value)
        a = _built[key]
        for batch in batches:
            at, raw = tokens.buffers(batch.column("text"))
            n_words, n_hit, owners, ranges, spans = [], [], [], [], []
            before = None if first else [batch.column(c).to_pylist() for c in ("items", "hit_words")]
            for i in range(batch.num_rows):
                text = raw[at[i]: at[i + 1]].tobytes()
                n, hit, items = scan(text, a)
                if before:
                    items |= set(before[0][i])
                    hit = merge(hit + [(x["from"], x["to"]) for x in before[1][i]])
                places = [m.span() for m in _WORD.finditer(text.decode())] if hit else []
                n_words.append(n)
                n_hit.append(sum(y - x for x, y in hit))
                owners.append(sorted(items))
                ranges.append([{"from": x, "to": y} for x, y in hit])
                spans.append([{"start": places[x][0], "end": places[y - 1][1]} for x, y in hit])
            pair = lambda p, q: pa.list_(pa.struct([(p, pa.int32()), (q, pa.int32())]))
            kept = [c for c in batch.schema.names if c in ("id", "text", "row")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [
                    pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(owners, pa.list_(pa.string())),
                    pa.array(ranges, pair("from", "to")), pa.array(spans, pair("start", "end"))],
                names=kept + ["n_words", "n_hit", "items", "hit_words", "spans"])

    return run


def contamination(df: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", max_bytes: int = 16 << 20, keep: list[str] | None = None) -> DataFrame:
    """One row per text: the ``keep`` columns (the id by default) with n_words, n_hit, items and the hit spans.

    A window is ``size`` consecutive item words, or the whole item when it has fewer. spans are
    code-point offsets [start, end) in the original text.
    """
    spark = df.sparkSession
    keep = [id_col] if keep is None else keep
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    made = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    row_type = made.schema["row"].dataType.simpleString()
    for k, part in enumerate(pattern_parts(benchmark, size, max_bytes, item_col, item_text)):
        shared = spark.sparkContext.broadcast(part)
        made = made.mapInArrow(_scanner(uuid4().hex, shared, k == 0), f"row {row_type}, text {kinds[text_col]}, {HIT_FIELDS}")
    own = {"n_words", "n_hit", "items", "hit_words", "spans"}
    return made.select(*[F.col(f"row.`{c}`").alias(c) for c in keep if c not in own], "n_words", "n_hit", "items", "spans")
