"""Aggregates of one's own with a state that merges, and sketches that are stored and rolled up.

``aggregate`` runs a ``Mergeable`` in two steps: each task folds its rows into one state a key, at most ``most_keys`` at once, and
only states are shuffled, where a grouped-aggregate Arrow function merges them. A hot key costs a row a task.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Mergeable(ABC):
    """An aggregate of rows of numbers whose state is a row of ``width`` numbers."""

    names: tuple[str, ...]
    width: int

    @abstractmethod
    def state(self, x: np.ndarray) -> np.ndarray:
        """The state of rows (n, columns), n at least 1."""

    @abstractmethod
    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The state of both states' rows."""

    @abstractmethod
    def result(self, s: np.ndarray) -> tuple[float | None, ...]:
        """The values of ``names``."""


class Moments(Mergeable):
    """Count, mean, population deviation, skewness and excess kurtosis of one column; the latter are null where all values are equal."""

    names, width = ("n", "mean", "std", "skewness", "kurtosis"), 5

    def state(self, x):
        v = x[:, 0]
        mean = v.mean()
        d = v - mean
        return np.array([len(v), mean, (d**2).sum(), (d**3).sum(), (d**4).sum()])

    def merge(self, a, b):
        n, d = a[0] + b[0], b[1] - a[1]
        p, q = a[0] / n, b[0] / n
        m2 = a[2] + b[2] + d**2 * a[0] * q
        m3 = a[3] + b[3] + d**3 * a[0] * q * (p - q) + 3 * d * (p * b[2] - q * a[2])
        m4 = a[4] + b[4] + d**4 * a[0] * q * (p * p - p * q + q * q) + 6 * d * d * (p * p * b[2] + q * q * a[2]) + 4 * d * (p * b[3] - q * a[3])
        return np.array([n, a[1] + d * q, m2, m3, m4])

    def result(self, s):
        n, mean, m2, m3, m4 = map(float, s)
        if m2 <= 1e-12 * n * max(1.0, mean * mean):
            return n, mean, (max(0.0, m2) / n) ** 0.5, None, None
        return n, mean, (m2 / n) ** 0.5, n**0.5 * m3 / m2**1.5, n * m4 / m2**2 - 3


class Fit(Mergeable):
    """Count, correlation, slope and intercept of a second column on a first; null where the first has one value only."""

    names, width = ("n", "correlation", "slope", "intercept"), 6

    def state(self, x):
        mean = x.mean(axis=0)
        d = x - mean
        return np.array([len(x), *mean, (d[:, 0] ** 2).sum(), (d[:, 1] ** 2).sum(), (d[:, 0] * d[:, 1]).sum()])

    def merge(self, a, b):
        n = a[0] + b[0]
        d = b[1:3] - a[1:3]
        w = a[0] * b[0] / n
        return np.array([n, *(a[1:3] + d * b[0] / n), a[3] + b[3] + d[0] ** 2 * w, a[4] + b[4] + d[1] ** 2 * w, a[5] + b[5] + d[0] * d[1] * w])

    def result(self, s):
        n, x, y, xx, yy, xy = map(float, s)
        if xx <= 0:
            return n, None, None, None
        return n, xy / (xx * yy) ** 0.5 if yy > 0 else None, xy / xx, y - x * xy / xx


def aggregate(df: DataFrame, keys: list[str], columns: list[str], agg: Mergeable, most_keys: int = 100_000) -> DataFrame:
    """(keys.., names..) of each key; rows with a null in a column do not count, and keys without others have no row. Null keys are a key."""
    values = [f"_v{k}" for k in range(len(columns))]
    rows = df.select(*keys, *(F.col(c).cast("double").alias(v) for c, v in zip(columns, values, strict=True))).dropna(subset=values)
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types = None

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([k[n] for k in held], t) for n, t in enumerate(types)]
            out = pa.RecordBatch.from_arrays([*arrays, pa.array(list(held.values()), pa.list_(pa.float64()))], [*keys, "state"])
            held.clear()
            return out

        for b in batches:
            if not len(b):
                continue
            types = [b.schema.field(k).type for k in keys]
            pdf = b.to_pandas()
            x = pdf[values].to_numpy(np.float64)
            for key, at in pdf.groupby(keys, dropna=False, sort=False).indices.items():
                first = int(at[0])
                key = tuple(b.column(k)[first].as_py() for k in keys)
                new = agg.state(x[at])
                held[key] = agg.merge(held[key], new) if key in held else new
            if len(held) > most_keys:
                yield flush()
        if held:
            yield flush()

    @F.arrow_udf("array<double>")
    def merged(states: pa.Array) -> float:
        rows = np.asarray(states.flatten(), np.float64).reshape(len(states), agg.width)
        total = rows[0]
        for s in rows[1:]:
            total = agg.merge(total, s)
        return total.tolist()

    @F.arrow_udf(f"struct<{','.join(f'{n}:double' for n in agg.names)}>")
    def finished(states: pa.Array) -> pa.Array:
        rows = np.asarray(states.flatten(), np.float64).reshape(len(states), agg.width)
        return pa.array([dict(zip(agg.names, agg.result(s), strict=True)) for s in rows], pa.struct([(n, pa.float64()) for n in agg.names]))

    states = rows.mapInArrow(run, f"{key_fields}, state array<double>")
    return states.groupBy(*keys).agg(merged("state").alias("state")).select(*keys, finished("state").alias("r")).select(*keys, "r.*")


# --- sketches


def sketch(df: DataFrame, keys: list[str | Column], distinct: str, value: str, lg_k: int = 12, kll_k: int = 400) -> DataFrame:
    """(keys.., n, distinct_sketch, value_sketch): a HyperLogLog sketch of a column's distinct values and a KLL sketch of a column's distribution.

    Sketches have a fixed size, are built before the shuffle, and merge by ``rolled_up``, so a table of them stands for its rows.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct).cast("string"), lg_k).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), kll_k).alias("value_sketch"))


def rolled_up(sketches: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Sketches of coarser keys from those of finer ones; no row of the data is read again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def estimated(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Sketches as numbers: n, n_distinct and the quantiles (p50, p95, ..); quantiles of no values are null."""
    keys = [c for c in sketches.columns if not c.endswith("_sketch")]
    some = F.kll_sketch_get_n_double("value_sketch") > 0
    at = [F.when(some, F.kll_sketch_get_quantile_double("value_sketch", F.lit(q))).alias(f"p{100 * q:g}".replace(".", "_")) for q in quantiles]
    return sketches.select(*keys, F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), *at)
