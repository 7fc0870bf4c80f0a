"""Language-model scoring from a log-frequency Bloom filter of n-gram counts.

Training tokens (words, then one end) are counted as unigrams and bigrams. A
count is quantised to a level of a logarithmic scale, and the n-gram is put into the filter once
per level up to its own, so a count is read by probing level after level until one is
missing. A bigram's probability interpolates its relative frequency with the add-half
unigram; the weight of a context depends on its level and is the Witten-Bell
weight of all training contexts at that level.

    p(w | v) = m(v) min(1, c(v w) / c(v)) + (1 - m(v)) (c(w) + 0.5) / (N + 0.5 (V + 1)),   m = sum C / (sum C + sum T)

Counting folds in each task before the shuffle, which deals n-grams by the hash of their context to
segments; the number of segments follows the training tokens. Each segment builds its own
piece of the filter, sized by its own entries. Pieces travel as broadcasts of at most ``shard_bytes``; a task walks
over them one at a time, so neither the driver nor a worker holds more than one, however large the corpus.
Bits of one n-gram lie in one 64-byte block. Unseen n-grams are taken as seen
with a chance of about one in a hundred; counts are never read too low, but for collisions of 64-bit keys.

Null and empty texts are one end token. A null id is in fold 0, so it is learned from.
Rows that share an id, or are equal, are texts of their own. Without training rows
every probability is that of N = V = 0. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.llm import tokens
from larder.llm.common import fold, rows_per_batch, written
from larder.llm.tokens import U, mix

PROBES, BITS_PER_ENTRY, WORD_BITS = 5, 10, 8
BLOCK_BITS = 512
FLUSH, GROUP_BYTES, SEGMENT_KEYS, PROBE_KEYS = 1 << 20, 4 << 20, 1 << 20, 1 << 16
END, START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
_UNI, _CTX = U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93)
_HIGH = U(((1 << 36) - 1) << 28)  # 36 bits of a bigram key tell its context, 28 the word


def _scale(step: float = 1.25) -> np.ndarray:
    """Smallest count of each level from 1: whole numbers growing by at least 1 and at least ``step`` times."""
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * step))))
    return np.array(out, dtype=np.int64)


LEVELS = _scale()
#: Count that a level stands for (0: unseen): the geometric mean of its ends.
COUNT_OF = np.concatenate([[0.0], np.sqrt(LEVELS[:-1] * (LEVELS[1:] - 1.0)), [float(LEVELS[-1])]])


def level(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, count, "right").astype(np.uint8)


def sequences(column) -> "list[tuple[int, int, np.ndarray, np.ndarray]]":
    """For each slice: first row, end row, token hashes with an end after each text, and where texts start."""
    for i, j, data, at in tokens.walk(column):
        h, row = tokens.word_hashes(data, at)
        n = np.bincount(row, minlength=j - i) + 1
        start = np.concatenate([[0], np.cumsum(n)])
        out = np.full(start[-1], END, dtype=U)
        out[np.arange(len(h)) + row] = h
        yield i, j, out, start


def contexts(tok: np.ndarray, start: np.ndarray) -> np.ndarray:
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[start[:-1]] = START
    return before


def uni_keys(tok: np.ndarray) -> np.ndarray:
    """Odd keys: unigrams."""
    return mix(tok ^ _UNI) | U(1)


def bi_keys(tok: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Even keys: bigrams, those of one context next to each other."""
    return (mix(before ^ _CTX) & _HIGH) | ((tok >> U(36)) & U(0xFFFFFFE))


def dealt(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys and their counts, one row per segment (the key's upper ``bits``)."""
    cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=U) << U(64 - bits))
    k, c = np.split(keys, cut), np.split(counts.astype(np.uint32), cut)
    at = [s for s in range(len(k)) if len(k[s])]
    return pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int32()), pa.array([k[s].tobytes() for s in at], pa.binary()), pa.array([c[s].tobytes() for s in at], pa.binary())],
        names=["seg", "keys", "counts"])


def _counter(bits: int, keys_of):
    """Sorted distinct keys with counts, by segment: one row of two byte strings per segment and flush."""

    def flush(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return dealt(keys, counts, bits)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, tok, start in sequences(batch.column("text")):
                held.append(keys_of(tok, start))
                size += len(tok)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _summed(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([np.frombuffer(x, dtype=U) for x in t.column("keys").to_pylist()])
    c = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in t.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def filter_bits(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The filter's bytes for n-grams at their levels."""
    entries = int(levels.sum())
    blocks = max(1, -(-entries * BITS_PER_ENTRY // BLOCK_BITS))
    flags = np.zeros(blocks * BLOCK_BITS, dtype=np.uint8)
    todo, j = np.arange(len(keys)), 1
    while len(todo):
        block = _block(keys[todo], blocks)
        for bit in _bits(keys[todo], j):
            flags[block * BLOCK_BITS + bit] = 1
        todo, j = todo[levels[todo] > j], j + 1
    return np.packbits(flags, bitorder="little")


def _block(keys: np.ndarray, blocks) -> np.ndarray:
    return (((mix(keys ^ U(0xA5A5A5A5A5A5A5A5)) >> U(32)) * np.asarray(blocks, dtype=U)) >> U(32)).astype(np.int64)


def _bits(keys: np.ndarray, j: int) -> list[np.ndarray]:
    g = mix(keys + U((j * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    return [((g >> U(9 * p)) & U(BLOCK_BITS - 1)).astype(np.int64) for p in range(PROBES)]


class Shard:
    """Pieces of the filter for consecutive segments, and exact counts of words whose hash lies in its range."""

    def __init__(self, bits: int, first: int, pieces: list[bytes], words: np.ndarray, counts: np.ndarray):
        self.shift, self.first, self.last = U(64 - bits), first, first + len(pieces)
        blocks = np.array([len(p) * 8 // BLOCK_BITS for p in pieces], dtype=np.int64)
        self.blocks, self.base = blocks, np.concatenate([[0], np.cumsum(blocks)[:-1]]) if len(blocks) else blocks
        self.data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.words, self.counts = words, counts

    def levels(self, keys: np.ndarray, out: np.ndarray) -> None:
        """Write the level read for each key that belongs here, a few keys at a time."""
        for a in range(0, len(keys), PROBE_KEYS):
            self._levels(keys[a: a + PROBE_KEYS], out[a: a + PROBE_KEYS])

    def _levels(self, keys: np.ndarray, out: np.ndarray) -> None:
        seg = (keys >> self.shift).astype(np.int64) if self.shift < 64 else np.zeros(len(keys), dtype=np.int64)
        todo = np.flatnonzero((seg >= self.first) & (seg < self.last))
        seg = seg[todo] - self.first
        todo, seg = todo[self.blocks[seg] > 0], seg[self.blocks[seg] > 0]
        k, at = keys[todo], (self.base[seg] + _block(keys[todo], self.blocks[seg])) * (BLOCK_BITS // 8)
        j = 1
        while len(todo) and j <= len(LEVELS):
            ok = np.ones(len(todo), dtype=bool)
            for bit in _bits(k, j):
                ok &= (self.data[at + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1
            todo, k, at = todo[ok], k[ok], at[ok]
            out[todo] = j
            j += 1

    def exact(self, tok: np.ndarray, out: np.ndarray) -> None:
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, tok), len(self.words) - 1)
            hit = self.words[at] == tok
            out[hit] = self.counts[at[hit]]


class Model:
    """Totals and context weights; the filter's shards are broadcasts."""

    def __init__(self, n: int, v: int, texts: int, weight: np.ndarray, shards: list):
        self.n, self.v, self.texts, self.weight, self.shards = n, v, texts, weight, shards


def fit(df: DataFrame, shard_bytes: int = 96 << 20) -> Model:
    """Learn from the texts in column ``text``."""
    spark, dealing = df.sparkSession, "seg int, keys binary, counts binary"

    def words(t: pa.Table) -> pa.Table:
        k, c = _summed(t)
        return pa.table({"seg": t.column("seg")[:1], "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([c.tobytes()], pa.binary()),
                         "v": pa.array([len(k)], pa.int64()), "n": pa.array([int(c.sum())], pa.int64())})

    uni = written(df.mapInArrow(_counter(WORD_BITS, lambda tok, start: tok), dealing).groupBy("seg").applyInArrow(
        words, dealing + ", v long, n long"), "lm-words")
    n, v = (int(x or 0) for x in uni.agg(F.sum("n"), F.sum("v")).first())
    bits = max(4, int(np.ceil(np.log2(max(1, n / SEGMENT_KEYS)))))

    def as_unigrams(batches):
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                k = uni_keys(np.frombuffer(keys, dtype=U))
                order = np.argsort(k)
                yield dealt(k[order], np.frombuffer(counts, dtype=np.int64)[order], bits)

    def piece(t: pa.Table) -> pa.Table:
        k, c = _summed(t)
        bi = (k & U(1)) == 0
        ctx, n_of = k[bi] & _HIGH, c[bi]
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(n_of, first) if len(first) else first
        by = level(total)
        sums = [np.bincount(by, weights=x, minlength=len(COUNT_OF)) for x in (total, np.diff(np.append(first, len(ctx))))]
        bits_of = filter_bits(k, level(c))
        return pa.table({"seg": t.column("seg")[:1], "bits": pa.array([bits_of.tobytes()], pa.binary()), "size": pa.array([len(bits_of)], pa.int64()),
                         "c": pa.array([sums[0].tolist()], pa.list_(pa.float64())), "t": pa.array([sums[1].tolist()], pa.list_(pa.float64()))})

    counted = df.mapInArrow(_counter(bits, lambda tok, start: bi_keys(tok, contexts(tok, start))), dealing)
    pieces = written(counted.unionByName(uni.select("seg", "keys", "counts").mapInArrow(as_unigrams, dealing)).groupBy("seg").applyInArrow(
        piece, "seg int, bits binary, size long, c array<double>, t array<double>"), "lm-filter")
    about = pieces.select("seg", "size", "c", "t").orderBy("seg").collect()  # one small row per segment
    c, t = (np.sum([r[x] for r in about], axis=0) if about else np.zeros(len(COUNT_OF)) for x in ("c", "t"))
    weight = np.where(c > 0, c / np.maximum(c + t, 1e-300), 0.0)
    return Model(n, v, df.count(), weight, _shards(uni, pieces, {r["seg"]: r["size"] for r in about}, bits, shard_bytes))


def _shards(uni: DataFrame, pieces: DataFrame, size: dict[int, int], bits: int, shard_bytes: int) -> list:
    """Broadcasts of at most ``shard_bytes`` each (a single larger piece goes alone), made one after another."""
    spark, out = uni.sparkSession, []
    sc = spark.sparkContext

    def packed(sizes: dict[int, int]) -> list[tuple[int, int]]:
        runs, used = [], 0
        for s in sorted(sizes):
            if runs and used + sizes[s] <= shard_bytes:
                runs[-1][1], used = s + 1, used + sizes[s]
            else:
                runs.append([s, s + 1])
                used = sizes[s]
        return [tuple(r) for r in runs]

    none = np.zeros(0, dtype=U)
    for a, b in packed(size):
        got = {r["seg"]: bytes(r["bits"]) for r in pieces.where((F.col("seg") >= a) & (F.col("seg") < b)).select("seg", "bits").toLocalIterator()}
        out.append(sc.broadcast(Shard(bits, a, [got.get(s, b"") for s in range(a, b)], none, none)))
        del got
    for a, b in packed({r["seg"]: r["v"] * 12 for r in uni.select("seg", "v").collect()}):
        got = sorted((r["seg"], r["keys"], r["counts"]) for r in uni.where((F.col("seg") >= a) & (F.col("seg") < b)).select("seg", "keys", "counts").toLocalIterator())
        out.append(sc.broadcast(Shard(bits, 0, [], np.concatenate([np.frombuffer(x[1], dtype=U) for x in got]),
                                      np.concatenate([np.frombuffer(x[2], dtype=np.int64) for x in got]).astype(np.uint32))))
        del got
    return out


def log_probabilities(model: Model, exact: np.ndarray, uni: np.ndarray, bi: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, model) log10 probability of each token."""
    whole = model.n + 0.5 * (model.v + 1)
    before = np.empty(len(uni), dtype=np.int64)
    before[1:] = uni[:-1]
    before[start[:-1]] = level(np.array([model.texts]))[0]
    c1, c0 = COUNT_OF[uni], COUNT_OF[before]
    m = model.weight[before]
    seen = np.where((uni > 0) & (before > 0), np.minimum(COUNT_OF[bi], np.minimum(c1, c0)), 0.0)
    p = m * seen / np.maximum(c0, 1.0) + (1 - m) * (c1 + 0.5) / whole
    return np.log10((exact + 0.5) / whole), np.log10(p)


def _groups(batches):
    """Batches regrouped to about GROUP_BYTES of text each, so a shard is loaded once for many texts."""
    held, size = [], 0
    for b in batches:
        at, _ = tokens.buffers(b.column("text"))
        for i, j in tokens.slices(at, GROUP_BYTES):
            held.append(b.slice(i, j - i))
            size += int(at[j] - at[i])
            if size >= GROUP_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _scorer(model: Model):
    def run(batches):
        for t in _groups(batches):
            if not t.num_rows:
                continue
            parts = list(sequences(t.column("text")))
            tok = np.concatenate([p[2] for p in parts])
            ends = np.cumsum([0, *(len(p[2]) for p in parts)])
            start = np.concatenate([*(p[3][:-1] + e for p, e in zip(parts, ends)), ends[-1:]])
            # each word and each bigram of the group is looked up once
            pairs, at2 = np.unique(bi_keys(tok, contexts(tok, start)), return_inverse=True)
            words, at1 = np.unique(tok, return_inverse=True)
            k1 = uni_keys(words)
            exact, uni, bi = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.uint8), np.zeros(len(pairs), dtype=np.uint8)
            for shard in model.shards:
                s = shard.value
                s.exact(words, exact)
                if len(s.data):
                    s.levels(k1, uni)
                    s.levels(pairs, bi)
                if len(model.shards) > 2:  # one at a time in memory
                    del shard._value
            exact, uni, bi = exact[at1], uni[at1], bi[at2]
            del tok, pairs, words, at1, at2, k1
            base, score = log_probabilities(model, exact, uni, bi, start)
            first = start[:-1]
            yield pa.RecordBatch.from_arrays(
                [t.column("id").combine_chunks(), pa.array(np.diff(start)), pa.array(np.add.reduceat((exact > 0).astype(np.int64), first)),
                 pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(score, first))],
                names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(df: DataFrame, folds: int = 5, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text",
                    shard_bytes: int = 96 << 20) -> DataFrame:
    """One row per text: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Rows of fold ``held_fold`` (crc32 of the id as text, modulo ``folds``) are scored but not learned from.
    """
    rows_per_batch(df.sparkSession, 2048)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    held = fold(F.col("id"), folds) == held_fold
    model = fit(docs.where(~held).select("text"), shard_bytes)
    kind = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(_scorer(model), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
                      "base_score", "score")
