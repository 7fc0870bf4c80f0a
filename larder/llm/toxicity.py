"""Toxicity by compression distance: one zstandard dictionary of ordinary text, one that holds toxic text too.

Every text is cut into windows of a few words. A window is compressed with both
dictionaries behind a carrier phrase that both hold, so that short windows stay
in the compressed regime; the difference of the two lengths is the window's distance.
Ordinary words compress alike in both, toxic ones only in one. The shares of
windows above each distance are turned into a probability by a logistic fit on labelled texts
that no dictionary saw, shifted so that 0.7 is the threshold of best F1 at the labelled rates.

The ordinary dictionary is trained on windows of ordinary texts. What is typical of toxic texts
is read from word beginnings: those that follow many different words in toxic texts and hardly any in
ordinary ones. Counting distinct neighbours, not occurrences, keeps copies of one text from counting.
The toxic dictionary holds the ordinary one and those beginnings, each as long as its words agree. (Training it
on whole toxic texts adds ordinary endings, which blur the distance.) The threshold is fitted with a
dictionary from one half of the sample on the other half; texts are scored with one from both.

The fit reads at most ``fit_rows`` labelled rows of each class and ``fit_bytes`` of their text. Null
and empty texts have no windows. Rows without id fall into fold 0. Rows that share an id are scored each;
without labels of both classes every score is 0, and an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from larder.llm import tokens
from larder.llm.common import fold, labelled_sample, rows_per_batch, written
from larder.llm.tokens import U, mix

WINDOW = 4
THRESHOLD = 0.7
MARKS = (1, 2, 3, 4)  # bytes of distance
CARRIER = b" both dictionaries open with these words. "
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TABLE = np.frombuffer(_NORMAL, dtype=np.uint8)
_IS_WORD = np.array([_NORMAL[b] != 32 for b in range(256)])
_LENGTHS = (3, 4, 5, 6, 8)
_made: dict[str, tuple] = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(text: bytes) -> list[bytes]:
    w = words(text)
    return [b" " + b" ".join(w[i: i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)]


def _beginnings(texts: list[bytes]):
    """For each slice of the texts: hashes of word beginnings, the word before, and a way to their bytes."""
    for _, _, data, at in tokens.walk(pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string())):
        data = _TABLE[data]
        s, e, _ = tokens.spans(data, at, _IS_WORD)
        if not len(s):
            continue
        h = tokens.hashes(data, s, e)
        before = np.concatenate([h[:1], h[:-1]])
        for k in (*_LENGTHS, 0):  # 0: the whole word and the space after it
            ok = np.flatnonzero(e - s >= k)
            end = s[ok] + k if k else e
            yield mix(tokens.hashes(data, s[ok], end) + U(k)), before[ok], lambda i, s=s[ok], end=end, k=k, data=data: (
                b" " + data[s[i]: end[i]].tobytes() + (b"" if k else b" "))


def _neighbours(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of word beginnings and how many different words come before each."""
    pairs, own = [], []
    for g, before, _ in _beginnings(texts):
        u, at = np.unique(mix(g * U(3) + mix(before)), return_index=True)
        pairs.append(u)
        own.append(g[at])
    if not pairs:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    at = np.unique(np.concatenate(pairs), return_index=True)[1]
    return np.unique(np.concatenate(own)[at], return_counts=True)


def typical(toxic: list[bytes], ordinary: list[bytes], least: int = 3, odds: float = 3.0, significance: float = 15.0) -> list[bytes]:
    """Word beginnings (with the space before them) typical of toxic texts, none of them beginning with another."""
    u, x = _neighbours(toxic)
    v, n = _neighbours(ordinary)
    if not len(u):
        return []
    at = np.minimum(np.searchsorted(v, u), max(len(v) - 1, 0))
    y = np.where(v[at] == u, n[at], 0) if len(v) else np.zeros(len(u), dtype=np.int64)
    na, nb = x.sum(), max(1, n.sum())
    share = na / (na + nb)
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (x * np.log(x / ((x + y) * share)) + np.where(y > 0, y * np.log(y / ((x + y) * (1 - share))), 0))
    good = u[(x >= least) & (np.log((x + 0.5) / na) - np.log((y + 0.5) / nb) > odds) & (g2 >= significance)]
    found: set[bytes] = set()
    for g, _, text in _beginnings(toxic) if len(good) else ():
        hit = np.flatnonzero(np.isin(g, good))
        found.update(text(i) for i in hit[np.unique(g[hit], return_index=True)[1]])
    out: set[bytes] = set()
    for s in sorted(found, key=lambda s: (len(s), s)):
        if not any(s[:k] in out for k in range(2, len(s))):
            out.add(s)
    return sorted(out)


def _trained(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-size:]


def stretched(stems: list[bytes], toxic: list[bytes], share: float = 0.9) -> list[bytes]:
    """Each beginning, made longer as long as ``share`` of the words with it go on alike."""
    seen = Counter(x for t in toxic for w in words(t) if (x := b" " + w + b" ").startswith(tuple(stems))) if stems else Counter()
    out = set()
    for s in stems:
        mine = Counter({w: n for w, n in seen.items() if w.startswith(s)})
        while mine:
            more = Counter()
            for w, n in mine.items():
                more[w[: len(s) + 1]] += n
            longer, n = more.most_common(1)[0]
            if len(longer) == len(s) or n < share * sum(mine.values()):
                break
            s = longer
        out.add(s)
    return sorted(out)


def train(toxic: list[bytes], ordinary: list[bytes], size: int = 4096) -> tuple[bytes, bytes]:
    """Contents of the (ordinary, toxic) dictionaries."""
    step = max(1, sum(len(t) for t in ordinary) // (100 * size * 8))  # about a hundred times the size is what training wants
    base = _trained(size, [w for t in ordinary for w in windows(t)[::step]])
    return base + CARRIER, base + b"".join(stretched(typical(toxic, ordinary), toxic)) + CARRIER


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters(
        window_log=14, hash_log=12, chain_log=12, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d)


def distances(text: bytes, ordinary, toxic) -> list[int]:
    return [len(ordinary(x)) - len(toxic(x)) for x in (CARRIER + w for w in windows(text))]


def features(counts: np.ndarray) -> np.ndarray:
    """From (windows, windows at or above each mark) per text."""
    n = np.maximum(counts[:, :1], 1).astype(float)
    c = counts[:, 1:].astype(float)
    return np.hstack([np.log1p(c), 10 * c / n, np.log((c + 0.05) / n), np.log1p(n)])


class Logistic:
    """Standardised ridge logistic regression by Newton steps, shifted to a threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        pull = ridge * np.eye(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            g = z.T @ (weight * (p - y)) + pull @ self.w
            step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + pull, g)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break
        # the threshold of best F1, placed at THRESHOLD
        s = z @ self.w
        order = np.argsort(-s, kind="stable")
        hit, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
        f1 = 2 * hit / (all_ + (weight * y).sum())
        k = int(np.argmax(f1))
        cut = s[order][k] if k + 1 == len(s) else (s[order][k] + s[order][k + 1]) / 2
        self.w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -30, 30)))


def _counter(shared, extra: list[str]):
    """(id, the ``extra`` columns, windows and counts at each mark) of every text."""
    key = uuid4().hex  # workers outlive models

    def run(batches):
        if key not in _made:
            _made.clear()
            _made[key] = tuple(_compressor(c).compress for c in shared.value)
        ordinary, toxic = _made[key]
        for batch in batches:
            at, raw = tokens.buffers(batch.column("text"))
            counts = np.zeros((batch.num_rows, 1 + len(MARKS)), dtype=np.int32)
            for i in range(batch.num_rows):
                d = np.array(distances(raw[at[i]: at[i + 1]].tobytes(), ordinary, toxic), dtype=np.int32)
                counts[i] = [len(d), *((d >= m).sum() for m in MARKS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in extra] + [pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * counts.shape[1], pa.array(counts.reshape(-1)))],
                names=[*extra, "counts"])

    return run


class Model:
    def __init__(self, docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_fold: int = 1, id_col: str = "doc_id",
                 text_col: str = "text", fit_rows: int = 3000, fit_bytes: int = 6 << 20):
        sample, known = labelled_sample(docs, labels, id_col, text_col, label, folds, held_fold, fit_rows, fit_bytes)
        self.logistic = None
        if len(known) < 2:
            return
        sample, sc = written(sample, "toxic-sample"), docs.sparkSession.sparkContext
        by: dict[tuple[int, int], list[bytes]] = {(p, y): [] for p in (0, 1) for y in (0, 1)}
        for r in sample.select("part", "label", "text").toLocalIterator():
            by[r["part"], r["label"]].append(r["text"].encode())
        half = sc.broadcast(train(sorted(by[0, 1]), sorted(by[0, 0])))  # part 1 stays unseen for the threshold
        seen = sample.where("part = 1").select("label", "text").mapInArrow(_counter(half, ["label"]), "label int, counts array<int>").toArrow()
        self.shared = sc.broadcast(train(sorted(by[0, 1] + by[1, 1]), sorted(by[0, 0] + by[1, 0])))
        y = seen.column("label").to_numpy().astype(float)
        if len(set(y)) < 2:
            return
        rate = np.array([known[0] / max(1, (y == 0).sum()), known[1] / max(1, (y == 1).sum())])
        weight = rate[y.astype(int)]
        self.logistic = Logistic(features(np.array(seen.column("counts").to_pylist())), y, weight / weight.mean())

    def score(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """The frame's columns as struct ``row``, with score."""
        made = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        if self.logistic is None:
            return made.select("row", F.lit(0.0).alias("score"))
        count, logistic = _counter(self.shared, ["row"]), self.logistic

        def run(batches):
            for b in count(batches):
                n = b.num_rows
                c = b.column("counts").flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1 + len(MARKS)))
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(logistic(features(c)))], names=["row", "score"])

        return made.mapInArrow(run, f"row {made.schema['row'].dataType.simpleString()}, score double")


def score_toxicity(df: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_fold: int = 1, id_col: str = "doc_id",
                   text_col: str = "text", **fit) -> DataFrame:
    """One row per text: id, held_out, score (0 to 1), predicted (1 from 0.7 on)."""
    rows_per_batch(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    model = Model(docs, labels, label, folds, held_fold, id_col, text_col, **fit)
    out = model.score(docs, id_col, text_col)
    doc_id = F.col(f"row.`{id_col}`")
    return out.select(doc_id.alias(id_col), (fold(doc_id, folds) == held_fold).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that are not predicted toxic, all columns as they are."""
    rows_per_batch(df.sparkSession)
    model = Model(df, labels, id_col=id_col, text_col=text_col)
    out = model.score(df, id_col, text_col).where(F.col("score") < THRESHOLD)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
