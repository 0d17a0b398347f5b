"""Percentiles with bounded error by deterministic buffer collapsing.

A sketch holds sorted buffers of equal size, the buffers of level l standing for 2**l values each, and a tail of
single values. Two buffers of a level merge by taking every other element of their union, so buffers rise in a
binary tree. A collapse of level l moves the rank of any value by at most 2**l: upwards if it keeps the odd elements,
downwards if the even ones. Each collapse goes the way whose sum so far is the smaller, so neither sum passes half of
all moves by more than the largest; both sums are kept, so each sketch carries its own proven bounds. Sketches of
files, days or partitions merge in any order. The sketches of a source come from many partitions and merge in a tree
of FAN branches, so that no task reads more than FAN sketches of it a day or file.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.medians import group_medians

#: Values that a source may have for the error bound to hold as stated; more only widen the bounds a sketch carries.
MOST = 1 << 40
FAN = 64
SKETCH = "source bigint, part int, n bigint, over bigint, under bigint, levels array<int>, buffers array<double>, tail array<double>"


def buffer_size(error: float = 0.01, most: int = MOST) -> int:
    """The least power of two of values a buffer that keeps the rank error within ``error`` of all values to either side.

    n values make n / (2 * size) collapses of weight one, half as many of weight two and so on: n / (2 * size) for each of
    log2(n / size) levels, of which either side takes half.
    """
    if not 0 < error < 1:
        raise ValueError("the error is a share of all values")
    size = 16
    while math.log2(max(2, most / size)) / (4 * size) > error:
        size *= 2
    return size


SIZE = buffer_size()


class Sketch:
    __slots__ = ("size", "n", "over", "under", "levels", "tail")

    def __init__(self, size: int = SIZE):
        self.size, self.n, self.over, self.under = size, 0, 0, 0
        self.levels: dict[int, np.ndarray] = {}
        self.tail = np.empty(0)

    def rise(self, level: int, buffer: np.ndarray) -> None:
        """Put a full buffer at its level; two of a level collapse into one of the next."""
        while level in self.levels:
            both = np.sort(np.concatenate([self.levels.pop(level), buffer]), kind="stable")
            if self.over > self.under:
                buffer, self.under = both[1::2], self.under + (1 << level)
            else:
                buffer, self.over = both[::2], self.over + (1 << level)
            level += 1
        self.levels[level] = buffer

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.refill(np.concatenate([self.tail, values]) if len(self.tail) else values)

    def refill(self, values: np.ndarray) -> None:
        full = len(values) // self.size * self.size
        for i in range(0, full, self.size):
            self.rise(0, np.sort(values[i : i + self.size]))
        self.tail = np.asarray(values[full:], dtype=float)

    def merge(self, n: int, over: int, under: int, levels: np.ndarray, buffers: np.ndarray, tail: np.ndarray) -> None:
        self.n, self.over, self.under = self.n + int(n), self.over + int(over), self.under + int(under)
        for level, buffer in zip(levels, np.asarray(buffers, dtype=float).reshape(-1, self.size)):
            self.rise(int(level), buffer)
        if len(tail):
            self.refill(np.concatenate([self.tail, np.asarray(tail, dtype=float)]))

    def row(self, source: int, part: int = 0) -> tuple:
        levels = sorted(self.levels)
        buffers = np.concatenate([self.levels[x] for x in levels]) if levels else np.empty(0)
        return source, part, self.n, self.over, self.under, levels, buffers, self.tail

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """All kept values in order and the number of values up to each."""
        values = np.concatenate([self.tail, *self.levels.values()])
        weights = np.concatenate([np.ones(len(self.tail), dtype="int64"), *[np.full(len(b), 1 << x, dtype="int64") for x, b in self.levels.items()]])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def at(self, ranks: list[int]) -> list[tuple[float, float, float]]:
        """(value, low, high) for each rank from 1: the value of that rank lies between low and high."""
        values, upto = self.weighted()
        pick = lambda r: float(values[min(np.searchsorted(upto, min(max(r, 1), self.n)), len(values) - 1)])
        return [(pick(r), pick(r - self.under), pick(r + self.over)) for r in ranks]


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source", "part", "n", "over", "under", "levels", "buffers", "tail"])


def build(size: int):
    """Sketches of the sorted, possibly repeated posts of a partition, one pass, bounded memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_at, sketch, last = None, None, None
        for pdf in frames:
            if not len(pdf):
                continue
            source, position, value = (pdf[c].to_numpy() for c in ("source", "position", "value"))
            new = np.ones(len(pdf), dtype=bool)
            new[1:] = (source[1:] != source[:-1]) | (position[1:] != position[:-1])
            new[0] = last != (source[0], position[0])
            last = (source[-1], position[-1])
            new &= ~np.isnan(value)
            source, value = source[new], value[new]
            rows = []
            if len(source):
                cuts = np.append(np.flatnonzero(np.append(True, source[1:] != source[:-1])), len(source))
                for i, j in zip(cuts[:-1], cuts[1:]):
                    if sketch is None or open_at != source[i]:
                        if sketch is not None:
                            rows.append(sketch.row(open_at, part))
                        open_at, sketch = source[i], Sketch(size)
                    sketch.add(value[i:j])
            if rows:
                yield frame(rows)
        if sketch is not None:
            yield frame([sketch.row(open_at, part)])

    return run


def combine(size: int, finish):
    """Merge the sketches of each (source, part) as they stream by in order; ``finish`` makes the output row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_at, sketch = None, None
        for pdf in frames:
            rows = []
            for source, part, *rest in pdf.itertuples(index=False, name=None):
                if sketch is None or open_at != (source, part):
                    if sketch is not None:
                        rows.append(finish(*open_at, sketch))
                    open_at, sketch = (source, part), Sketch(size)
                sketch.merge(*rest)
            if rows:
                yield finish.frame(rows)
        if sketch is not None:
            yield finish.frame([finish(*open_at, sketch)])

    return run


class AsSketch:
    schema = SKETCH
    frame = staticmethod(frame)

    def __call__(self, source: int, part: int, sketch: Sketch) -> tuple:
        return sketch.row(source, part)


class AsPercentiles:
    """One row a source: for each share the lower and upper middle value's mean and proven bounds."""

    def __init__(self, shares: tuple[float, ...]):
        self.shares = shares
        self.names = ["source", "n", "rank_error", *[f"p{round(s * 100)}{x}" for s in shares for x in ("", "_low", "_high")]]
        self.schema = "source bigint, n bigint, rank_error bigint, " + ", ".join(f"{x} double" for x in self.names[3:])

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names)

    def __call__(self, source: int, part: int, sketch: Sketch) -> tuple:
        out: list = [source, sketch.n, max(sketch.over, sketch.under)]
        for s in self.shares:
            spot = s * (sketch.n - 1)
            low = int(np.floor(spot))
            (a, al, ah), (b, bl, bh) = sketch.at([low + 1, min(low + 2, sketch.n)])
            f = spot - low
            out += [a + f * (b - a), al + f * (bl - al), ah + f * (bh - ah)]
        return tuple(out)


def sketch_values(posts: DataFrame, source: str, position: str, value: str, size: int = SIZE) -> DataFrame:
    """Sketches of a counter per source and partition; merge them with ``merge_sketches``.

    Repeated (source, position) rows count once and nulls are left out. Range partitioning spreads a source with a third
    of all rows over many partitions, each of which sends on one sketch of it. A table without values gives no rows.
    """
    rows = posts.select(F.col(source).cast("long").alias("source"), F.col(position).cast("long").alias("position"), F.col(value).cast("double").alias("value"))
    rows = rows.where("source is not null and position is not null and value is not null")
    return rows.repartitionByRange("source", "position").sortWithinPartitions("source", "position").mapInPandas(build(size), SKETCH)


def merge_sketches(sketches: DataFrame, finish=None, size: int = SIZE) -> DataFrame:
    """One sketch (or finished row) a source, from any number of partial ones; the order is fixed, so the result is too.

    FAN neighbouring parts merge a round. The number of rounds follows from the number of shuffle partitions alone.
    """
    rounds = max(1, math.ceil(math.log(int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")), FAN) - 1e-9))
    for i in range(rounds):
        last = i == rounds - 1
        upper = F.lit(0) if last else F.floor(F.col("part") / FAN)
        placed = sketches.withColumn("part", upper.cast("int")).repartition("source", "part")
        ordered = placed.sortWithinPartitions("source", "part", "n", "over", "under", "levels", "tail", "buffers")
        how = (finish or AsSketch()) if last else AsSketch()
        sketches = ordered.mapInPandas(combine(size, how), how.schema)
    return sketches


def percentiles(posts: DataFrame, source: str = "channel_id", position: str = "msg_id", value: str = "views", shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9), size: int = SIZE) -> DataFrame:
    """source, n, rank_error and, for each share, pNN (linear between ranks), pNN_low and pNN_high."""
    return merge_sketches(sketch_values(posts, source, position, value, size), AsPercentiles(shares), size)


def wrong_medians(posts: DataFrame, scorecard: DataFrame, tolerance: float = 0.2, size: int = SIZE) -> DataFrame:
    """tg_id of scorecard rows whose median_views is null, not a number, or off by more than the tolerance.

    The sketch's bounds decide alone where they leave no doubt; channels whose stored value lies too near the limit for
    the bounds get an exact check, the median of their own posts. Channels without posts and repeated rows give nothing more.
    """
    medians = percentiles(posts, shares=(0.5,), size=size)
    stored = scorecard.select(F.col("tg_id").cast("long").alias("source"), F.col("median_views").cast("double").alias("stored"))
    rows = stored.join(medians, "source")
    off = lambda m: F.abs(F.col("stored") - m) > tolerance * F.abs(m)
    broken = F.col("stored").isNull() | F.isnan("stored")
    # over the interval the test is monotone on either side of the stored value
    low, high, stored_at = F.col("p50_low"), F.col("p50_high"), F.col("stored")
    inside = (low <= stored_at) & (stored_at <= high)
    sure_off = off(low) & off(high) & ~inside & (F.signum(low) == F.signum(high)) & ((stored_at < low) == (stored_at < high))
    sure_ok = ~off(low) & ~off(high) & (F.signum(low) == F.signum(high))
    verdict = F.when(broken, True).when(low == high, off(low)).when(sure_off, True).when(sure_ok, False)
    judged = rows.withColumn("wrong", verdict)
    unsure = judged.where("wrong is null").select("source", "stored").distinct()
    keyed = posts.select(F.col("channel_id").cast("long").alias("source"), F.col("msg_id").cast("long").alias("position"), F.col("views").cast("double").alias("views"))
    distinct = keyed.join(unsure.select("source").distinct(), "source", "left_semi").groupBy("source", "position").agg(F.max("views").alias("views"))
    exact = group_medians(distinct, ["source"], ["views"]).join(unsure, "source").where(off(F.col("median"))).select("source")
    return judged.where("wrong").select("source").unionByName(exact).select(F.col("source").alias("tg_id")).distinct()
