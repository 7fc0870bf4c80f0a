"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on at most ``sample_rows`` rows (smallest id hashes), which
bounds what the driver holds; every row is indexed by descending to its leaf. A
query walks the tree through a priority queue of nodes, nearest centre first,
and visits leaves in that order. The number of visits is calibrated: the
``probe_queries`` rows of smallest hash are answered exactly over all rows, and
visits widen until the leaves seen hold ``target_recall`` of their true neighbours.

Leaves are packed into bins of at most ``bin_rows`` rows, a larger leaf is split
over several by id hash, and queries come in blocks, so a task holds one bin and one
block however large the index or a leaf grows. Of equal vectors in a bin only the k + 1 smallest
ids can be answers, because ties go to the smaller id; the rest are not scored.

Inner product is turned into distance by one more coordinate, sqrt(m^2 - |x|^2),
zero for queries. Scores are recomputed in double precision on the original vectors.

Vectors that are null, zero, hold null or non-finite components, or are not of
the table's commonest length take no part, as rows without id. A query id that is repeated is
asked once, with its smallest vector; a candidate row never answers a query of its own id.
Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import rows_per_batch, written


class Tree:
    """Centres of all nodes (root first), children by node; leaves are numbered in tree order."""

    def __init__(self, x: np.ndarray, branching: int, depth: int, seed: int = 5):
        self.centres, self.children, self.leaf = [x.mean(axis=0)], [[]], []
        rng = np.random.default_rng(seed)
        self._split(0, x, branching, depth, rng)
        self.centres = np.array(self.centres)
        order = self._leaves(0)
        self.leaf = np.full(len(self.centres), -1, dtype=np.int64)
        self.leaf[order] = np.arange(len(order))
        self.n_leaves = len(order)

    def _leaves(self, node: int) -> list[int]:
        return [node] if not self.children[node] else [z for c in self.children[node] for z in self._leaves(c)]

    def _split(self, node: int, x: np.ndarray, k: int, depth: int, rng) -> None:
        if depth == 0 or len(x) < 4 * k:
            return
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            near = _distances(x, c).argmin(axis=1)
            c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        near = _distances(x, c).argmin(axis=1)
        full = [j for j in range(k) if (near == j).any()]
        if len(full) < 2:  # one point repeated
            return
        for j in full:
            self.centres.append(c[j])
            self.children.append([])
            self.children[node].append(len(self.children) - 1)
        for child, j in zip(list(self.children[node]), full):
            self._split(child, x[near == j], k, depth - 1, rng)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row descends to."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            near = _distances(x[rows], self.centres[kids]).argmin(axis=1)
            todo += [(c, rows[near == j]) for j, c in enumerate(kids) if (near == j).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[list[int]]:
        """For each query the first ``most`` leaves of a best-bin-first walk."""
        far = _distances(q, self.centres)
        out = []
        for d in far:
            heap, seen = [(d[0], 0)], []
            while heap and len(seen) < most:
                _, node = heapq.heappop(heap)
                if self.children[node]:
                    for c in self.children[node]:
                        heapq.heappush(heap, (d[c], c))
                else:
                    seen.append(int(self.leaf[node]))
            out.append(seen)
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate that turns inner product into distance."""
    return np.hstack([x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))[:, None]])


def _asked(q: np.ndarray) -> np.ndarray:
    return np.hstack([q, np.zeros((len(q), 1))])


def best(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, seen=None, block: int = 256):
    """(query, ids, scores) of each query's k largest inner products, ties to smaller ids.

    ``seen``: for each query the mask of rows it may use. Matrix products find candidates; scores
    of those are summed row by row, so they don't depend on a row's place.
    """
    for a in range(0, len(q), block):
        s = q[a: a + block] @ x.T
        if seen is not None:
            s = np.where(seen[a: a + block], s, -np.inf)
        m = min(k + 1, s.shape[1])  # one more: the query itself may be among them
        kth = -np.partition(-s, m - 1, axis=1)[:, m - 1] if m else None
        for i in range(len(s)):
            at = np.flatnonzero((s[i] >= kth[i] - 1e-9 * (1 + abs(kth[i]))) & (s[i] > -np.inf)) if np.isfinite(kth[i]) else np.flatnonzero(s[i] > -np.inf)
            at = at[x_id[at] != q_id[a + i]]
            exact = (x[at] * q[a + i]).sum(axis=1)
            order = np.lexsort((x_id[at], -exact))[:k]
            yield int(q_id[a + i]), x_id[at][order], exact[order]


def _few_copies(x: np.ndarray, x_id: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be answers: of equal vectors the k + 1 smallest ids."""
    raw = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8)))[:, 0]
    _, group = np.unique(raw, return_inverse=True)
    order = np.lexsort((x_id, group))
    g = group[order]
    start = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0))
    return np.sort(order[np.arange(len(g)) - start <= k])


def _answers(rows):
    q, ids, scores = zip(*rows) if rows else ((), (), ())
    return pa.table({"q": pa.array(q, pa.int64()), "hits": pa.array(
        [[{"far": -float(s), "id": int(i)} for i, s in zip(a, b)] for a, b in zip(ids, scores)],
        pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())])))})


HITS = "q long, hits array<struct<far:double,id:long>>"


def _merge(hits: DataFrame, k: int) -> DataFrame:
    return hits.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part, v in double precision."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda e: e.cast("double"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf))
        & F.exists("v", lambda e: e != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


class Index:
    def __init__(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", branching: int = 8, depth: int = 3,
                 sample_rows: int = 16384, bin_rows: int = 8192):
        spark = df.sparkSession
        rows_per_batch(spark, 4096)
        self.bin_rows = bin_rows
        rows = usable(df, id_col, vec_col)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
        self.top = rows.agg(F.max(norm)).first()[0] or 0.0
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()
        self.empty = sample.num_rows == 0
        if self.empty:
            return
        self.tree = Tree(_lifted(_matrix(sample.column("v")), self.top), branching, depth)
        shared, top = spark.sparkContext.broadcast(self.tree), self.top

        def assign(batches):
            for b in batches:
                leaf = shared.value.assign(_lifted(_matrix(b.column("v")), top)) if b.num_rows else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(leaf, pa.int32())], names=["id", "v", "leaf"])

        self.rows = written(rows.mapInArrow(assign, "id long, v array<double>, leaf int"), "ann-index")
        self.shared = shared
        self._pack()

    def _pack(self) -> None:
        """Bins of leaves in tree order; at most one row per leaf comes to the driver."""
        self.bins: dict[int, tuple[int, int]] = {}  # leaf: first bin, number of bins
        used, at = self.bin_rows, -1
        for leaf, n in sorted((r["leaf"], r["count"]) for r in self.rows.groupBy("leaf").count().collect()):
            if n > self.bin_rows:
                parts = -(-n // self.bin_rows)
                self.bins[leaf] = (at + 1, parts)
                at, used = at + parts, self.bin_rows
            else:
                if used + n > self.bin_rows:
                    at, used = at + 1, 0
                self.bins[leaf] = (at, 1)
                used += n

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """Every row against a bounded set of queries (at most a few hundred, broadcast)."""
        q = queries.toArrow()
        qv, qi = _matrix(q.column("v")), q.column("id").to_numpy()
        shared = self.rows.sparkSession.sparkContext.broadcast((qv, qi))

        def scan(batches):
            for b in batches:
                if b.num_rows:
                    qv, qi = shared.value
                    yield from _answers(list(best(qv, qi, _matrix(b.column("v")), b.column("id").to_numpy(), k))).to_batches()

        return _merge(self.rows.select("id", "v").mapInArrow(scan, HITS), k)

    def calibrate(self, k: int, target_recall: float, probe_queries: int = 200) -> tuple[int, float]:
        """Fewest leaf visits whose recall over the probes reaches the target, and that recall."""
        probes = self.rows.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(probe_queries).select("id", "v")
        probes = probes.groupBy("id").agg(F.min("v").alias("v"))
        truth = self.exact(probes, k).select("q", F.explode("hits.id").alias("id"))
        place = truth.join(self.rows.select("id", "leaf"), "id").groupBy("q", "id").agg(F.min("leaf").alias("leaf")).collect()
        p = probes.toArrow()
        walks = dict(zip(p.column("id").to_pylist(), self.tree.visits(_asked(_matrix(p.column("v"))), self.tree.n_leaves)))
        rank = np.sort([walks[r["q"]].index(r["leaf"]) for r in place])
        if not len(rank):
            return self.tree.n_leaves, 1.0
        need = int(rank[min(len(rank) - 1, math.ceil(target_recall * len(rank)) - 1)]) + 1
        return need, float((rank < need).mean())

    def search(self, queries: DataFrame, k: int, visits: int, query_block: int = 65536) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k best found; ``queries`` holds (id, v)."""
        queries = queries.groupBy("id").agg(F.min("v").alias("v"))
        blocks = max(1, -(-queries.count() // query_block))
        bins, shared = self.bins, self.shared

        def route(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                bin_, row, leaves = [], [], []
                for i, walk in enumerate(shared.value.visits(_asked(_matrix(b.column("v"))), visits)):
                    per: dict[int, list[int]] = {}
                    for leaf in walk:
                        first, parts = bins.get(leaf, (0, 0))
                        for at in range(first, first + parts):
                            per.setdefault(at, []).append(leaf)
                    for at, inside in per.items():
                        bin_.append(at)
                        row.append(i)
                        leaves.append(inside)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bin_, pa.int32()), b.column("id").take(take), b.column("v").take(take), pa.array(leaves, pa.list_(pa.int32()))],
                    names=["bin", "q", "qv", "leaves"])

        def score(members: pa.Table, asked: pa.Table) -> pa.Table:
            if not members.num_rows or not asked.num_rows:
                return _answers([])
            x, ids = _matrix(members.column("v")), members.column("id").to_numpy()
            keep = _few_copies(x, ids, k)
            x, ids, leaf = x[keep], ids[keep], members.column("leaf").to_numpy()[keep]
            q, qi = _matrix(asked.column("qv")), asked.column("q").to_numpy()
            of = asked.column("leaves").to_pylist()
            out = []
            for a in range(0, len(q), 256):  # leaf masks of one block of queries at a time
                seen = np.array([np.isin(leaf, w) for w in of[a: a + 256]])
                out += list(best(q[a: a + 256], qi[a: a + 256], x, ids, k, seen))
            return _answers(out)

        plan = self.rows.sparkSession.createDataFrame([(leaf, *at) for leaf, at in bins.items()], "leaf int, first int, parts int")
        block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
        members = self.rows.join(F.broadcast(plan), "leaf").select(
            (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("bin"), "leaf", "id", "v",
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        asked = queries.mapInArrow(route, "bin int, q long, qv array<double>, leaves array<int>").withColumn("block", block)
        hits = members.groupBy("bin", "block").cogroup(asked.groupBy("bin", "block")).applyInArrow(score, HITS)
        return _merge(hits, k).select(F.col("q").alias("query_id"), F.posexplode("hits").alias("at", "hit")).select(
            "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))


def nearest(df: DataFrame, every: int = 20, k: int = 20, target_recall: float = 0.96, id_col: str = "vec_id", vec_col: str = "embedding",
            **index) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``."""
    found = Index(df, id_col, vec_col, **index)
    if found.empty:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    visits, _ = found.calibrate(k, target_recall)
    return found.search(found.rows.where(F.col("id") % every == 0).select("id", "v"), k, visits)
