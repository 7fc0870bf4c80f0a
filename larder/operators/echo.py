"""Next-day model over windows of daily changes: an echo-state network.

The reservoir is fixed by a seed; only the readout is learned, from one Gram matrix that every task adds up over its windows and
Spark sums. A series travels as one sorted array, at most a value a calendar day, and its windows are views of that array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.operators.demand import SERIES

UNITS, RADIUS, LEAK, DENSITY = 64, 0.9, 0.6, 0.1
DIRECT = 14  # newest changes that also reach the readout directly
RIDGE = 1e-3  # per window


def series_arrays(df: DataFrame, target: str) -> DataFrame:
    """One row per series: dates and values in order of date."""
    pairs = F.sort_array(F.collect_list(F.struct("date", F.col(target).cast("double").alias("v"))))
    return df.groupBy(*SERIES).agg(pairs.alias("_p")).select(*SERIES, F.col("_p.date").alias("dates"), F.col("_p.v").alias("values"))


@dataclass
class Network:
    """Reservoir and readout; inputs are divided by ``scale``."""

    length: int
    scale: float
    inner: np.ndarray
    into: np.ndarray
    bias: np.ndarray
    readout: np.ndarray

    @classmethod
    def fresh(cls, length: int, scale: float, seed: int = 42) -> Network:
        rng = np.random.default_rng(seed)
        w = rng.normal(size=(UNITS, UNITS)) * (rng.random((UNITS, UNITS)) < DENSITY)
        w *= RADIUS / max(np.abs(np.linalg.eigvals(w)).max(), 1e-9)
        return cls(length, scale, w, rng.uniform(-1, 1, UNITS), rng.uniform(-0.2, 0.2, UNITS), np.zeros(1 + DIRECT + UNITS))

    def features(self, windows: np.ndarray) -> np.ndarray:
        """Constant, newest changes and last state of each window (rows x length)."""
        u = windows / self.scale
        h = np.zeros((len(u), UNITS))
        for k in range(u.shape[1]):
            h = (1 - LEAK) * h + LEAK * np.tanh(h @ self.inner.T + u[:, k: k + 1] * self.into + self.bias)
        newest = np.zeros((len(u), DIRECT))
        n = min(DIRECT, u.shape[1])
        newest[:, DIRECT - n:] = u[:, u.shape[1] - n:]
        return np.hstack([np.ones((len(u), 1)), newest, h])

    def next(self, windows: np.ndarray) -> np.ndarray:
        """The change after each window."""
        return self.features(windows) @ self.readout * self.scale


def changes(values: np.ndarray) -> np.ndarray:
    """Change against the day before; the first keeps its value."""
    return np.diff(values, prepend=0.0)


def cut(values: np.ndarray, length: int, test_rows: int, min_train: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(windows, the change after each, how many of them are for training): full windows only; none if too few are left to train."""
    d = changes(values)
    n = len(d) - length
    if n - test_rows < min_train or n <= 0:
        return np.zeros((0, length)), np.zeros(0), 0
    return np.lib.stride_tricks.sliding_window_view(d, length)[:n], d[length:], n - test_rows


def _each(batches):
    """(keys of a series as one-row columns, dates, values) one series after the other."""
    for batch in batches:
        dates, values = batch.column("dates"), batch.column("values")
        for i in range(batch.num_rows):
            yield batch.slice(i, 1), dates[i].values, np.nan_to_num(values[i].values.to_numpy(zero_copy_only=False).astype(float))


def _moments(length: int, test_rows: int, min_train: int):
    def run(batches):
        n, s = 0, 0.0
        for _, _, v in _each(batches):
            _, y, m = cut(v, length, test_rows, min_train)
            n, s = n + m, s + float((y[:m] ** 2).sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [s]}, schema=pa.schema([("n", pa.int64()), ("s", pa.float64())]))

    return run


def _grams(net: Network, test_rows: int, min_train: int):
    def run(batches):
        size = 1 + DIRECT + UNITS
        total = np.zeros((size, size + 1))
        for _, _, v in _each(batches):
            x, y, m = cut(v, net.length, test_rows, min_train)
            for i in range(0, m, 4096):
                z = net.features(x[i: min(i + 4096, m)])
                total += z.T @ np.column_stack([z, y[i: min(i + 4096, m)] / net.scale])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

    return run


def fit(series: DataFrame, length: int = 60, test_rows: int = 0, min_train: int = 1) -> Network:
    """Readout by ridge regression over the training windows of all series; two passes, a few thousand numbers to the driver."""
    m = series.mapInArrow(_moments(length, test_rows, min_train), "n long, s double").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    net = Network.fresh(length, float(np.sqrt(m["s"] / m["n"])) if m["n"] and m["s"] else 1.0)
    if not m["n"]:
        return net
    size = 1 + DIRECT + UNITS
    gram = np.zeros(size * (size + 1))
    got = series.mapInArrow(_grams(net, test_rows, min_train), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    gram[got["cell"].to_numpy()] = got["v"].to_numpy()
    gram = gram.reshape(size, size + 1)
    net.readout = np.linalg.solve(gram[:, :size] + RIDGE * m["n"] * np.eye(size), gram[:, size])
    return net


def _key_fields(series: DataFrame) -> str:
    return ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in SERIES)


def holdout_forecasts(series: DataFrame, net: Network, test_rows: int, min_train: int, target: str) -> DataFrame:
    """Last value plus the forecast change, not below 0, beside the value of the day after, for the held-out windows."""
    shared = series.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for one, dates, v in _each(batches):
            x, _, m = cut(v, net.length, test_rows, min_train)
            if len(x) == m:
                continue
            at = np.arange(net.length - 1 + m, len(v) - 1)
            keys = one.take(pa.array(np.zeros(len(at), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*[keys.column(c) for c in SERIES], dates.take(pa.array(at)), pa.array(v[at]), pa.array(v[at + 1]), pa.array(np.maximum(v[at] + net.next(x[m:]), 0))],
                names=[*SERIES, "date", target, "actual_next", "predicted_next"])

    return series.mapInArrow(run, f"{_key_fields(series)}, date date, {target} double, actual_next double, predicted_next double")


def next_day(series: DataFrame, net: Network) -> DataFrame:
    """Forecast of the day after the data per series; short histories are padded with zeros on the left."""
    shared = series.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for batch in batches:
            values = [np.nan_to_num(v.values.to_numpy(zero_copy_only=False).astype(float)) for v in batch.column("values")]
            x = np.zeros((len(values), net.length))
            for i, v in enumerate(values):
                d = changes(v)[-net.length:]
                x[i, net.length - len(d):] = d
            last = np.array([v[-1] for v in values])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in SERIES], pa.array(np.maximum(last + net.next(x), 0))], names=[*SERIES, "delta_forecast"])

    return series.mapInArrow(run, f"{_key_fields(series)}, delta_forecast double")
