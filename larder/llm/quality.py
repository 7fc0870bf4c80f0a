"""Quality from random-indexing word vectors and a two-layer network.

Every token (a run of letters, of digits or of other marks, case kept) falls
into one of ``BUCKETS`` by hash and has a fixed sparse random index vector. The
word vectors are gathered from all texts: each occurrence adds the index
vectors of its neighbours. A text is the mean of its tokens' index vectors and
of their unit context vectors; how long these means are tells how much a text repeats itself.
A two-layer numpy network learns the label from them on a bounded sample, and
a temperature fitted on the other half of the sample calibrates its probabilities.

The table of word vectors has a fixed size, so partial tables are summed by
bucket range and the whole is a bounded broadcast. The fit reads at most
``fit_rows`` labelled rows of each class and ``fit_bytes`` of their text.

Null and empty texts have the features of no tokens and get a score like any
other. Rows without id fall into fold 0, rows that share an id are scored
each, without labels of both classes every score is the share of label 1 (0 without
labels), an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.llm import tokens
from larder.llm.common import fold, labelled_sample, rows_per_batch, written
from larder.llm.tokens import U, mix

BUCKETS, DIM, ONES, RANGES = 8192, 32, 6, 8
WINDOW = 2
THRESHOLD = 0.7
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[~tokens.NOT_SPACE] = 0


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, the same everywhere: row b is drawn from b."""
    r = np.zeros((BUCKETS, DIM), dtype=np.float32)
    for k in range(ONES):
        g = mix(np.arange(BUCKETS, dtype=U) * U(1000003) + U(k + 1))
        r[np.arange(BUCKETS), (g % U(DIM)).astype(np.int64)] += np.where((g >> U(40)) & U(1), 1, -1).astype(np.float32)
    return r / np.sqrt(np.float32(ONES))


def buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each token of a slice."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    c = _CLASS[data]
    new = np.ones(len(c) + 1, dtype=bool)
    new[1:-1] = c[1:] != c[:-1]
    edges = at[1:-1]
    new[edges] = True
    cut = np.flatnonzero(new)
    s, e = cut[:-1], cut[1:]
    s, e = s[c[s] > 0], e[c[s] > 0]
    h = tokens.hashes(data, s, e, tokens.BYTE_EXACT)
    return (h % U(BUCKETS)).astype(np.int64), np.searchsorted(at, s, "right") - 1


def _contexts(batches):
    """Summed neighbour vectors of each bucket seen, one row per bucket range and task."""
    r, total, seen = index_vectors(), np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS, dtype=bool)
    for batch in batches:
        for _, _, data, at in tokens.walk(batch.column("text")):
            b, row = buckets(data, at)
            if not len(b):
                continue
            own = r[b]
            near = np.zeros_like(own)
            for d in range(1, WINDOW + 1):
                same = (row[d:] == row[:-d])[:, None]
                near[d:] += own[:-d] * same
                near[:-d] += own[d:] * same
            order = np.argsort(b, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(b[order]) > 0]))
            at_b = b[order][first]
            total[at_b] += np.add.reduceat(near[order], first, axis=0)
            seen[at_b] = True
    step = BUCKETS // RANGES
    for k in range(RANGES):
        at = np.flatnonzero(seen[k * step: (k + 1) * step]) + k * step
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([total[at].astype(np.float32).tobytes()], pa.binary())],
                names=["part", "at", "sums"])


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros((BUCKETS, DIM))
    for at, sums in sorted(zip(t.column("at").to_pylist(), t.column("sums").to_pylist())):
        total[np.frombuffer(at, dtype=np.int32)] += np.frombuffer(sums, dtype=np.float32).reshape(-1, DIM)
    at = np.flatnonzero(np.abs(total).sum(axis=1))
    return pa.table({"part": t.column("part")[:1], "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "sums": pa.array([total[at].astype(np.float32).tobytes()], pa.binary())})


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Index vectors beside unit context vectors of every bucket, from all texts (column ``text``)."""
    fields = "part int, at binary, sums binary"
    ctx = np.zeros((BUCKETS, DIM), dtype=np.float32)
    for r in texts.mapInArrow(_contexts, fields).groupBy("part").applyInArrow(_add, fields).toLocalIterator():
        ctx[np.frombuffer(r["at"], dtype=np.int32)] = np.frombuffer(r["sums"], dtype=np.float32).reshape(-1, DIM)
    ctx /= np.maximum(np.linalg.norm(ctx, axis=1, keepdims=True), 1e-6)
    return np.hstack([index_vectors(), ctx])


def pooled(column, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: the mean vectors, their lengths and the logged number of tokens."""
    out = np.zeros((len(column), 2 * DIM + 3), dtype=np.float64)
    for i, j, data, at in tokens.walk(column):
        b, row = buckets(data, at)
        if not len(b):
            continue
        full, first, n = np.unique(row, return_index=True, return_counts=True)
        mean = np.add.reduceat(vectors[b], first, axis=0) / n[:, None]
        out[i + full, : 2 * DIM] = mean
        out[i + full, 2 * DIM] = np.log(np.linalg.norm(mean[:, :DIM], axis=1) + 1e-3)
        out[i + full, 2 * DIM + 1] = np.log(np.linalg.norm(mean[:, DIM:], axis=1) + 1e-3)
        out[i + full, 2 * DIM + 2] = np.log1p(n)
    return out


class Network:
    """Input, one hidden layer of tanh units, one logit; Adam with weight decay; a temperature on top."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 150, batch: int = 128, rate: float = 3e-3,
                 decay: float = 1e-3, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = x.mean(axis=0), x.std(axis=0) + 1e-6, 1.0
        x = (x - self.mean) / self.scale
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                a = np.tanh(x[at] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-np.clip(a @ self.p[2] + self.p[3], -30, 30))) - y[at]) / len(at)
                h = np.outer(d, self.p[2]) * (1 - a * a)
                t += 1
                for k, g in enumerate((x[at].T @ h, h.sum(axis=0), a.T @ d, np.array([d.sum()]))):
                    g = g + decay * self.p[k] * (k in (0, 2))
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature of least weighted log loss on rows the network has not seen."""
        z = self.logit(x)
        grid = np.geomspace(0.2, 20, 200)
        loss = [(weight * (np.logaddexp(0, z / t) - y * z / t)).sum() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def score_quality(df: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_fold: int = 2, id_col: str = "doc_id",
                  text_col: str = "text", fit_rows: int = 4000, fit_bytes: int = 12 << 20) -> DataFrame:
    """One row per text: id, held_out, score (0 to 1), predicted (1 from 0.7 on)."""
    rows_per_batch(df.sparkSession)
    sc = df.sparkSession.sparkContext
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    sample, known = labelled_sample(df, labels, id_col, text_col, label, folds, held_fold, fit_rows, fit_bytes)
    kind = docs.schema["id"].dataType.simpleString()
    held = (fold(F.col("id"), folds) == held_fold).alias("held_out")
    if len(known) < 2:
        return docs.select(F.col("id").alias(id_col), held, F.lit(float(1 in known)).alias("score"), F.lit(int(1 in known)).alias("predicted"))
    vectors = sc.broadcast(word_vectors(docs.select("text")))

    def pool(batches):
        for b in batches:
            x = pooled(b.column("text"), vectors.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), b.column("part"), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.reshape(-1)))],
                names=["label", "part", "x"])

    got = written(sample.select("label", "part", "text").mapInArrow(pool, "label int, part int, x array<double>"), "quality-sample").orderBy("label", "part", "x").toArrow()
    x, y, part = np.array(got.column("x").to_pylist()), got.column("label").to_numpy().astype(float), got.column("part").to_numpy()
    rate = np.array([known[0] / max(1, (y == 0).sum()), known[1] / max(1, (y == 1).sum())])
    weight = rate[y.astype(int)] / rate.max()
    learn = part == 0
    if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
        learn = np.ones(len(y), dtype=bool)
    net = Network(x[learn], y[learn])
    rest = ~learn if (~learn).any() else learn
    net.calibrate(x[rest], y[rest], weight[rest])
    model = sc.broadcast(net)

    def score(batches):
        for b in batches:
            s = model.value(pooled(b.column("text"), vectors.value)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s)], names=["id", "score"])

    out = docs.mapInArrow(score, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
