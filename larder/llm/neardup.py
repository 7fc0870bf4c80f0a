"""Near duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A signature holds ``symbols`` MinHash values of 16 bits; the distance of two
signatures is the number of symbols that differ. It is cut into chunks, and by
the pigeonhole rule two signatures at distance <= chunks * (errors + 1) - 1
have a chunk with at most ``errors`` differing symbols. Each chunk enumerates its
allowed errors as keys that leave those symbols out, so every pair under the
distance threshold shares a key. Candidates within the threshold are confirmed
on the full shingle sets of their texts.

Documents with equal sets are one class; only its smallest id is signed into
buckets. A bucket is first tested by a star: its centre against its other members.
What that joins needs no further test. Buckets that still hold several components are tested in full:
small ones by their pairs, large ones in blocks whose tasks answer with a spanning set of links, so a group of
thousands of near copies never turns into all its pairs. The chance that a pair at the similarity
threshold lies outside the signature distance is stated by ``miss_chance``.

Null and empty texts have no shingles and no links. A null id takes part in
nothing; its component is null and it is kept. Rows sharing an id are one
document: each row reports the smallest component of the id's texts. Equal rows
are answered once each; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.llm import tokens
from larder.llm.common import broadcast_if_small, rows_per_batch, written
from larder.llm.components import components
from larder.llm.tokens import U, mix

SYMBOLS, CHUNKS, ERRORS = 32, 8, 1
SMALL = 64  # members of a bucket whose open pairs are listed
BLOCK_SHINGLES = 1 << 20
_A = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
_B = mix(np.arange(1001, 1257, dtype=U)) | U(1)


def radius(chunks: int = CHUNKS, errors: int = ERRORS) -> int:
    return chunks * (errors + 1) - 1


def miss_chance(similarity: float, symbols: int = SYMBOLS, chunks: int = CHUNKS, errors: int = ERRORS) -> float:
    """Chance that a pair of this similarity is outside the signature distance."""
    p = 1 - similarity
    return sum(comb(symbols, d) * p**d * (1 - p) ** (symbols - d) for d in range(radius(chunks, errors) + 1, symbols + 1))


def signatures(v: np.ndarray, first: np.ndarray, symbols: int) -> np.ndarray:
    """16-bit MinHash symbols (rows x symbols) of the sets v[first[i]:first[i + 1]], none of them empty."""
    out = np.empty((len(first), symbols), dtype=np.uint16)
    for k in range(symbols):
        t = (v ^ _A[k]) * _B[k]
        t ^= t >> U(29)
        t *= U(0xBF58476D1CE4E5B9)
        out[:, k] = mix(np.minimum.reduceat(t, first)) >> U(48)
    return out


def chunk_keys(sig: np.ndarray, chunks: int = CHUNKS, errors: int = ERRORS) -> np.ndarray:
    """Keys (rows x keys): each chunk without each choice of ``errors`` symbols."""
    width = sig.shape[1] // chunks
    wide, keys = sig.astype(U), []
    for c in range(chunks):
        for n, kept in enumerate(combinations(range(width), width - errors)):
            h = np.full(len(sig), c * 1000 + n + 1, dtype=U)
            for k in kept:
                h = mix(h * U(0x9E3779B97F4A7C15) + wide[:, c * width + k])
            keys.append(h)
    return np.stack(keys, axis=1) if len(sig) else np.zeros((0, chunks * comb(width, errors)), dtype=U)


def _sign(width: int, symbols: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            size, sums, sig = np.zeros(n, dtype=np.int64), np.zeros((2, n), dtype=U), [None] * n
            for i, j, data, at in tokens.walk(batch.column("text")):
                h, row = tokens.word_hashes(data, at)
                v, r = tokens.shingles(h, row, j - i, width)
                if not len(v):
                    continue
                full, first, count = np.unique(r, return_index=True, return_counts=True)
                size[i + full] = count
                for s in (0, 1):
                    sums[s][i + full] = np.add.reduceat(mix(v ^ _A[200 + s]), first)
                for k, x in zip(full, signatures(v, first, symbols)):
                    sig[i + k] = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(sig, pa.binary())],
                names=["id", "n", "sa", "sb", "sig"])

    return run


def _keys(symbols: int, chunks: int, errors: int):
    def run(batches):
        for batch in batches:
            sig = np.array([np.frombuffer(x, dtype=np.uint16) for x in batch.column("sig").to_pylist()], dtype=np.uint16).reshape(-1, symbols)
            keys = chunk_keys(sig, chunks, errors)
            offsets = np.arange(len(sig) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))], names=["id", "keys"])

    return run


def _near(symbols: int, most: int):
    def run(batches):
        for batch in batches:
            x, y = (np.array([np.frombuffer(s, dtype=np.uint16) for s in batch.column(c).to_pylist()], dtype=np.uint16).reshape(-1, symbols)
                    for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= most))

    return run


def sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted shingle set of each text."""
    out: list[np.ndarray] = []
    for i, j, data, at in tokens.walk(pa.array(texts, pa.large_string())):
        h, row = tokens.word_hashes(data, at)
        v, r = tokens.shingles(h, row, j - i, width)
        cut = np.searchsorted(r, np.arange(j - i + 1))
        out += [v[cut[k]: cut[k + 1]] for k in range(j - i)]
    return out


def _confirm(width: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts = dict(zip(a, batch.column("text_a").to_pylist())) | dict(zip(b, batch.column("text_b").to_pylist()))
            of = dict(zip(texts, sets(list(texts.values()), width)))
            ok = []
            for x, y in zip(a, b):
                both = len(np.intersect1d(of[x], of[y], assume_unique=True))
                ok.append(100 * both >= percent * (len(of[x]) + len(of[y]) - both) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links(width: int, percent: int):
    """Links of one pair of blocks that join components not joined before: a spanning set of them."""

    def run(t: pa.Table) -> pa.Table:
        root: dict = {}

        def find(i):
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        ids, of = t.column("id").to_pylist(), t.column("component").to_pylist()
        own = sets(t.column("text").to_pylist(), width)
        size = np.array([len(x) for x in own])
        v, owner = np.concatenate(own), np.repeat(np.arange(len(own)), size)
        order = np.argsort(v, kind="stable")
        held = owner[order]  # owners by shingle
        _, first, n = np.unique(v[order], return_index=True, return_counts=True)
        place = np.empty(len(v), dtype=np.int64)
        place[order] = np.repeat(np.arange(len(first)), n)
        cut, a, b = np.concatenate([[0], np.cumsum(size)]), [], []
        for x in range(len(own)):
            mine = place[cut[x]: cut[x + 1]]
            mine = mine[n[mine] > 1]
            if not len(mine):
                continue
            both = np.bincount(np.concatenate([held[first[k]: first[k] + n[k]] for k in mine]), minlength=len(own))
            near = np.flatnonzero(100 * both >= percent * (size[x] + size - both))
            for y in near[near > x]:
                p, q = find(of[x]), find(of[y])
                if p != q:
                    root[p] = q
                    a.append(min(ids[x], ids[y]))
                    b.append(max(ids[x], ids[y]))
        kind = t.schema.field("id").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    return run


def _by_blocks(left: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, pair: str) -> DataFrame:
    """Links across components inside large open buckets, without emitting pairs.

    Documents that share such buckets, directly or through others, are a group. A group is cut into blocks of about
    BLOCK_SHINGLES shingles, and every pair of blocks is a task that tests its documents on their full sets.
    """
    group = components(left.select(F.col("centre").alias("a"), F.col("id").alias("b"))).withColumnRenamed("component", "g")
    members = written(left.select("id", "component").distinct().join(group, "id").join(classes.select("id", "n"), "id"), "members")
    blocks = members.groupBy("g").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = members.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("n")
    dealt = docs.join(broadcast_if_small(placed), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("id", "component", "text", "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).groupBy(
        "g", "i", "j").applyInArrow(_links(width, percent), pair)


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    symbols: int = SYMBOLS, chunks: int = CHUNKS, errors: int = ERRORS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept.

    Links: 100 * intersection >= percent * union of the ``width``-word shingle sets.
    """
    if symbols % chunks or symbols // chunks <= errors:
        raise ValueError("chunks must divide the symbols and be longer than the errors allowed")
    rows_per_batch(df.sparkSession)
    most = radius(chunks, errors)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    pair = f"a {kind}, b {kind}"
    signed = written(docs.mapInArrow(_sign(width, symbols), f"id {kind}, n long, sa long, sb long, sig binary"), "signed")
    # copies fold into one class before any shuffle of the signatures' keys
    classes = written(signed.where("n > 0 AND id IS NOT NULL").groupBy("sa", "sb", "n").agg(
        F.min("id").alias("id"), F.first("sig").alias("sig")), "classes")
    keyed = classes.select("id", "sig").mapInArrow(_keys(symbols, chunks, errors), f"id {kind}, keys array<long>").select(
        "id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("top")).where("centre <> top")
    buckets = written(keyed.join(shared.select("key", "centre"), "key"), "buckets")

    sigs = classes.select("id", "n", "sig")

    def test(pairs: DataFrame) -> DataFrame:
        """The pairs within the signature distance that the full sets confirm."""
        p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        p = p.join(sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sig_a")), "a").join(
            sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sig_b")), "b")
        p = p.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        close = written(p.select("a", "b", "sig_a", "sig_b").mapInArrow(_near(symbols, most), pair), "close")
        wanted = close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct()
        texts = written(docs.join(broadcast_if_small(wanted), "id", "left_semi"), "texts")
        full = close.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return written(full.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, percent), pair), "confirmed")

    joined = written(components(test(buckets.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")))), "joined")
    # what is left: buckets that hold more than one component
    of = buckets.select("key", "id", "centre").join(joined, "id", "left").select("key", "id", "centre", F.coalesce("component", "id").alias("component"))
    open_keys = of.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members")).where(
        "x <> y").select("key", "members")
    left = written(of.join(open_keys, "key"), "open")
    few = left.where(F.col("members") <= SMALL)
    pairs = few.join(few.select("key", F.col("id").alias("b"), F.col("component").alias("cb")), "key").where(
        (F.col("id") < F.col("b")) & (F.col("component") != F.col("cb"))).select(F.col("id").alias("a"), "b")
    found = test(pairs).unionByName(_by_blocks(left.where(F.col("members") > SMALL), docs, classes, width, percent, pair))
    joined = written(components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found)), "joined")
    member = classes.select("sa", "sb", "n", F.col("id").alias("rep")).join(
        joined.withColumnRenamed("id", "rep"), "rep", "left").select("sa", "sb", "n", F.coalesce("component", "rep").alias("c"))
    rows = signed.select("id", "n", "sa", "sb").join(member, ["sa", "sb", "n"], "left")
    own = rows.groupBy("id").agg(F.coalesce(F.min("c"), F.col("id")).alias("component_id"))
    return rows.join(own, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        (F.col("component_id").isNull() | (F.col("component_id") == F.col("id"))).alias("kept"))


def keep_one(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows of one document of each group, the smallest id; repeated rows of it stay once, rows without an id all."""
    groups = near_duplicates(df, width, percent, id_col, text_col).select(F.col(f"`{id_col}`").alias(id_col), "kept")
    groups = written(groups, "kept").where(F.col(f"`{id_col}`").isNotNull())
    gone = groups.where("NOT kept").select(id_col).distinct()
    twice = groups.where("kept").groupBy(id_col).count().where("count > 1").select(id_col)
    single = df.join(broadcast_if_small(gone.unionByName(twice)), id_col, "left_anti")
    once = df.join(broadcast_if_small(twice), id_col, "left_semi").dropDuplicates([id_col])
    return single.select(*df.columns).unionByName(once.select(*df.columns))
