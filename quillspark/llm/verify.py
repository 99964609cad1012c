"""Exact verification of candidate pairs: both texts are brought to a pair and compared by what is made of them."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import heavy_values, materialize, salted_join


def with_both(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b, ..) with ``columns`` of both nodes as a_ and b_; nodes of many pairs are dealt over several tasks."""
    out = pairs
    for end, other in (("a", "b"), ("b", "a")):
        heavy = heavy_values(pairs.groupBy(end).agg(F.count("*").alias("n")), end, "n")
        own = nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
        out = salted_join(out, own, [end], heavy, F.col(other), salts=16)
    return out


class Held:
    """What ``make`` gives for the texts met last, by node, of at most ``most`` bytes together (one text may be larger)."""

    def __init__(self, make: Callable[[str | None], np.ndarray], most: int = 64 << 20):
        self.make, self.most, self.bytes = make, most, 0
        self.sets: OrderedDict[int, np.ndarray] = OrderedDict()

    def of(self, node: int, text: pa.Scalar) -> np.ndarray:
        found = self.sets.get(node)
        if found is None:
            found = self.sets[node] = self.make(text.as_py())
            self.bytes += found.nbytes
            while self.bytes > self.most and len(self.sets) > 1:
                self.bytes -= self.sets.popitem(last=False)[1].nbytes
        else:
            self.sets.move_to_end(node)
        return found


def verified(pairs: DataFrame, nodes: DataFrame, make: Callable[[str | None], np.ndarray], enough: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """The pairs (a, b) of which ``enough`` holds for what ``make`` gives for their texts, which is made once for all pairs of a task while it is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(make)
        for b in batches:
            ends = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)
            yield b.select(["a", "b"]).filter(pa.array([enough(held.of(x, s), held.of(y, t)) for x, y, s, t in ends], pa.bool_()))

    both = with_both(pairs, nodes, "text").select("a", "b", "a_text", "b_text")
    return materialize(both.mapInArrow(run, "a long, b long"), "verified")
