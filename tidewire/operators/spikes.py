"""Implausible numbers: a hidden Markov model per source with normal, spike, stuck and out-of-range states.

The posts are range-partitioned by (source, position), so a source with a third of all rows spreads over
many partitions. All sources form one chain of 4x4 step matrices per metric, in which the first post of
a source resets the state. A first pass over each partition multiplies its inner matrices; the driver
chains these products (one row a partition, whatever the data) and a second pass runs forward and
backward with the right state at both ends of each partition. Runs of equal values cross partition
bounds by the same summaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.medians import group_medians
from tidewire.session import materialise

STATES = ("normal", "spike", "stuck", "out_of_range")
CHUNK = 64
#: Posts that a partition holds at most: some 250 MB of arrays in a Python worker.
PARTITION_ROWS = 200_000


@dataclass(frozen=True)
class SpikeParams:
    """``least``, ``times`` and ``run`` are the exact rules; the rest shapes the model's emissions."""

    least: float = 50.0
    times: float = 10.0
    run: int = 4
    metrics: tuple[str, ...] = ("views", "forwards", "reactions")
    whole: str = "views"
    parts: tuple[str, ...] = ("forwards", "reactions")
    suspicion: float = 0.1
    start: tuple[float, ...] = (0.96, 0.02, 0.01, 0.01)
    steps: tuple[tuple[float, ...], ...] = field(default=((0.965, 0.02, 0.01, 0.005), (0.70, 0.27, 0.02, 0.01), (0.15, 0.02, 0.82, 0.01), (0.75, 0.02, 0.01, 0.22)))


def emissions(x: np.ndarray, median: np.ndarray, spread: np.ndarray, equal: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Likelihoods [n, metric, state]; a null says nothing (all ones), an impossible value leaves one state."""
    spread = np.clip(np.nan_to_num(spread, nan=0.3), 0.15, 0.5)
    with np.errstate(invalid="ignore", divide="ignore"):
        z = (np.log1p(np.maximum(x, 0)) - np.log1p(np.maximum(median, 0))) / spread
        normal = np.exp(-0.5 * np.minimum(z * z, 60)) * 0.4 / spread + 1e-9
        spike = np.where(z > 0, 0.3 * (1 - np.exp(-0.5 * np.minimum(z * z, 60))), 1e-6) + 1e-9
    out = np.empty((*x.shape, 4))
    out[..., 0] = normal * np.where(equal, 0.04, 0.96)
    out[..., 1] = spike * np.where(equal, 0.04, 0.96)
    out[..., 2] = 0.2 * np.where(equal, 0.97, 0.03)
    out[..., 3] = 1e-6
    out[bad] = (1e-9, 1e-9, 1e-9, 1.0)
    out[np.isnan(x)] = 1.0
    return out


def step_matrices(likelihood: np.ndarray, resets: np.ndarray, params: SpikeParams) -> np.ndarray:
    """[n, metric, 4, 4]: transition times emission; a reset forgets the state before it."""
    steps = np.asarray(params.steps)
    a = steps[None, None] * likelihood[:, :, None, :]
    if resets.any():
        a[resets] = (np.asarray(params.start) * likelihood[resets])[:, :, None, :]
    return a


def chunked(a: np.ndarray) -> np.ndarray:
    """[chunk, CHUNK, metric, 4, 4], filled up with identities."""
    n = len(a)
    fill = -n % CHUNK
    if fill:
        a = np.concatenate([a, np.broadcast_to(np.eye(4), (fill, *a.shape[1:]))])
    return a.reshape(-1, CHUNK, *a.shape[1:])


def chunk_products(c: np.ndarray) -> np.ndarray:
    product = c[:, 0].copy()
    for j in range(1, CHUNK):
        product = product @ c[:, j]
        product /= product.max(axis=(-1, -2), keepdims=True) + 1e-300
    return product


def chain(a: np.ndarray) -> np.ndarray:
    """The scaled product of all matrices of [n, metric, 4, 4]."""
    total = np.broadcast_to(np.eye(4), (a.shape[1], 4, 4)).copy()
    if len(a):
        for p in chunk_products(chunked(a)):
            total = total @ p
            total /= total.max(axis=(-1, -2), keepdims=True) + 1e-300
    return total


def posterior(a: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """State probabilities [n, metric, 4]; ``before`` is the forward row, ``after`` the backward column at the ends."""
    n = len(a)
    if not n:
        return np.empty((0, a.shape[1], 4))
    c = chunked(a)
    products = chunk_products(c)
    unit = lambda v: v / (v.sum(axis=-1, keepdims=True) + 1e-300)
    starts, ends = [unit(before)], [unit(after)]
    for p in products[:-1]:
        starts.append(unit((starts[-1][:, None, :] @ p)[:, 0]))
    for p in products[:0:-1]:
        ends.append(unit((p @ ends[-1][:, :, None])[..., 0]))
    forward, backward = np.empty((*c.shape[:3], 4)), np.empty((*c.shape[:3], 4))
    at = np.stack(starts)
    for j in range(CHUNK):
        at = unit((at[:, :, None, :] @ c[:, j])[:, :, 0])
        forward[:, j] = at
    at = np.stack(ends[::-1])
    for j in range(CHUNK - 1, -1, -1):
        backward[:, j] = at
        at = unit((c[:, j] @ at[..., None])[..., 0])
    both = forward * backward
    both = both.reshape(-1, *both.shape[2:])[:n]
    return unit(both)


class Block:
    """The sorted, distinct posts of one partition as arrays."""

    def __init__(self, pdf: pd.DataFrame, params: SpikeParams):
        m = params.metrics
        self.key = pdf["source"].to_numpy()
        self.at = pdf["position"].to_numpy()
        self.x = pdf[list(m)].to_numpy(dtype="float64")
        self.median = pdf[[f"{k}_median" for k in m]].to_numpy(dtype="float64")
        self.spread = pdf[[f"{k}_spread" for k in m]].to_numpy(dtype="float64")
        self.params = params
        with np.errstate(invalid="ignore"):
            self.bad = self.x < 0
            whole = self.x[:, m.index(params.whole)]
            for part in params.parts:
                self.bad[:, m.index(part)] |= self.x[:, m.index(part)] > whole

    def __len__(self) -> int:
        return len(self.key)

    def likelihood(self, before: tuple | None, after: tuple | None, where: slice = slice(None)) -> np.ndarray:
        """Emissions given the (key, values) next to the block on either side."""
        same = np.zeros((len(self) + 1, self.x.shape[1]), dtype=bool)
        same[1:-1] = (self.x[1:] == self.x[:-1]) & (self.key[1:] == self.key[:-1])[:, None]
        if before is not None and before[0] == self.key[0]:
            same[0] = self.x[0] == np.asarray(before[1])
        if after is not None and after[0] == self.key[-1]:
            same[-1] = self.x[-1] == np.asarray(after[1])
        return emissions(self.x[where], self.median[where], self.spread[where], (same[:-1] | same[1:])[where], self.bad[where])

    def resets(self, before: tuple | None) -> np.ndarray:
        out = np.empty(len(self), dtype=bool)
        out[1:] = self.key[1:] != self.key[:-1]
        out[0] = before is None or before[0] != self.key[0]
        return out

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(start index, length) of each row's run of equal values, for each metric."""
        n, k = self.x.shape
        new = np.ones((n, k), dtype=bool)
        new[1:] = ~((self.x[1:] == self.x[:-1]) & (self.key[1:] == self.key[:-1])[:, None])
        first = np.maximum.accumulate(np.where(new, np.arange(n)[:, None], 0), axis=0)
        length = np.empty((n, k), dtype="int64")
        for j in range(k):
            heads = np.flatnonzero(new[:, j])
            size = np.diff(np.append(heads, n))
            length[:, j] = np.repeat(size, size)
        return first, length


def whole(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = [f for f in frames if len(f)]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


def summarise(params: SpikeParams):
    """Pass one: an inner product of step matrices and the edge rows of each partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = whole(frames)
        if not len(pdf):
            return
        b = Block(pdf, params)
        inner = step_matrices(b.likelihood(None, None), b.resets(None), params)[1:-1]
        first, length = b.runs()
        yield pd.DataFrame(
            {
                "pid": [int(pdf["pid"].iloc[0])],
                "n": [len(b)],
                "product": [chain(inner).ravel().tolist()],
                "keys": [[int(b.key[0]), int(b.key[-1])]],
                "resets_last": [bool(len(b) > 1 and b.key[-1] != b.key[-2])],
                "edges": [np.stack([b.x[[0, -1]], b.median[[0, -1]], b.spread[[0, -1]]]).ravel().tolist()],
                "lead": [length[0].tolist()],
                "tail": [length[-1].tolist()],
            }
        )

    return run


SUMMARY = "pid int, n bigint, product array<double>, keys array<bigint>, resets_last boolean, edges array<double>, lead array<bigint>, tail array<bigint>"


def contexts(rows: list, params: SpikeParams) -> dict[int, dict]:
    """For each partition, what lies around it: neighbour rows, states at its ends, runs that reach in."""
    m, k = params.metrics, len(params.metrics)
    rows = sorted(rows, key=lambda r: r["pid"])
    out = {r["pid"]: {} for r in rows}
    edge = []
    for r in rows:
        x, median, spread = np.asarray(r["edges"], dtype=float).reshape(3, 2, k)
        edge.append({"x": x, "median": median, "spread": spread, "key": r["keys"]})
    for i, r in enumerate(rows):
        out[r["pid"]]["before"] = (edge[i - 1]["key"][1], edge[i - 1]["x"][1].tolist()) if i else None
        out[r["pid"]]["after"] = (edge[i + 1]["key"][0], edge[i + 1]["x"][0].tolist()) if i + 1 < len(rows) else None

    def matrices(i: int) -> list[np.ndarray]:
        """First, inner and last step matrices of partition i."""
        r, e = rows[i], edge[i]
        near = out[r["pid"]]
        pdf = pd.DataFrame({"source": [e["key"][0], e["key"][1]], "position": [0, 0]})
        for j, name in enumerate(m):
            pdf[name], pdf[f"{name}_median"], pdf[f"{name}_spread"] = e["x"][:, j], e["median"][:, j], e["spread"][:, j]
        if r["n"] == 1:
            b = Block(pdf.iloc[:1], params)
            return [step_matrices(b.likelihood(near["before"], near["after"]), b.resets(near["before"]), params)[0]]
        b = Block(pdf, params)
        lead, tail = np.asarray(r["lead"]) > 1, np.asarray(r["tail"]) > 1
        if near["before"] is not None and near["before"][0] == b.key[0]:
            lead = lead | (b.x[0] == np.asarray(near["before"][1]))
        if near["after"] is not None and near["after"][0] == b.key[-1]:
            tail = tail | (b.x[1] == np.asarray(near["after"][1]))
        like = emissions(b.x, b.median, b.spread, np.stack([lead, tail]), b.bad)
        resets = np.array([near["before"] is None or near["before"][0] != b.key[0], r["resets_last"]])
        first, last = step_matrices(like, resets, params)
        return [first, np.asarray(r["product"]).reshape(k, 4, 4), last]

    state = np.broadcast_to(np.asarray(params.start), (k, 4))
    steps = [matrices(i) for i in range(len(rows))]
    for i, r in enumerate(rows):
        out[r["pid"]]["state"] = state
        for a in steps[i]:
            state = (state[:, None, :] @ a)[:, 0]
            state = state / (state.sum(axis=-1, keepdims=True) + 1e-300)
    state = np.ones((k, 4))
    for i in range(len(rows) - 1, -1, -1):
        out[rows[i]["pid"]]["rest"] = state
        for a in reversed(steps[i]):
            state = (a @ state[..., None])[..., 0]
            state = state / (state.sum(axis=-1, keepdims=True) + 1e-300)
    reach = np.zeros(k, dtype="int64")
    for i, r in enumerate(rows):
        joined = (edge[i - 1]["x"][1] == edge[i]["x"][0]) & (edge[i - 1]["key"][1] == edge[i]["key"][0]) if i else np.zeros(k, bool)
        out[r["pid"]]["reach_in"] = np.where(joined, reach, 0)
        reach = np.asarray(r["tail"]) + np.where((np.asarray(r["tail"]) == r["n"]) & joined, reach, 0)
    reach = np.zeros(k, dtype="int64")
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        joined = (edge[i + 1]["x"][0] == edge[i]["x"][1]) & (edge[i + 1]["key"][0] == edge[i]["key"][1]) if i + 1 < len(rows) else np.zeros(k, bool)
        out[r["pid"]]["reach_out"] = np.where(joined, reach, 0)
        reach = np.asarray(r["lead"]) + np.where((np.asarray(r["lead"]) == r["n"]) & joined, reach, 0)
    return out


def flag(params: SpikeParams, around):
    """Pass two: probabilities, the most likely state and run length of every number that is suspicious or that an exact rule may take."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = whole(frames)
        if not len(pdf):
            return
        near = around.value[int(pdf["pid"].iloc[0])]
        b = Block(pdf, params)
        a = step_matrices(b.likelihood(near["before"], near["after"]), b.resets(near["before"]), params)
        p = posterior(a, near["state"], near["rest"])
        first, length = b.runs()
        n = len(b)
        full = length + np.where(first == 0, near["reach_in"], 0) + np.where(first + length == n, near["reach_out"], 0)
        known = ~np.isnan(b.x)
        with np.errstate(invalid="ignore"):
            ruled = (b.x >= params.least) & ((b.x >= params.times * b.median) | (full >= params.run))
        take = known & ((1 - p[..., 0] >= params.suspicion) | b.bad | ruled)
        i, j = np.nonzero(take)
        state = p[i, j].argmax(axis=-1)
        state = np.where(b.bad[i, j], 3, state)
        yield pd.DataFrame(
            {
                "source": b.key[i],
                "position": b.at[i],
                "metric": np.asarray(params.metrics, dtype=object)[j],
                "value": b.x[i, j],
                "median": b.median[i, j],
                "run": full[i, j],
                "impossible": b.bad[i, j],
                "state": np.asarray(STATES, dtype=object)[state],
                "p_odd": 1 - p[i, j, 0],
            }
        )

    return run


FLAGS = "source bigint, position bigint, metric string, value double, median double, run bigint, impossible boolean, state string, p_odd double"


def flag_numbers(posts: DataFrame, source: str, position: str, params: SpikeParams = SpikeParams()) -> DataFrame:
    """Every number that the model does not hold for normal or an exact rule takes, with its state, probability and run length.

    Repeated (source, position) rows count once (of differing repeats, the greatest numbers); rows without a source or
    position are left out; a null number is never flagged and ends a run. An empty table gives no rows; extra columns
    are ignored.
    """
    m = list(params.metrics)
    keyed = posts.select(F.col(source).cast("long").alias("source"), F.col(position).cast("long").alias("position"), *[F.col(c).cast("double").alias(c) for c in m])
    distinct = materialise(keyed.where("source is not null and position is not null").groupBy("source", "position").agg(*[F.max(c).alias(c) for c in m]))
    stats = group_medians(distinct, ["source"], m)
    pick = lambda c, name: F.max(F.when(F.col("metric") == c, F.col(name)))
    wide = stats.groupBy("source").agg(*[pick(c, "median").alias(f"{c}_median") for c in m], *[pick(c, "log_spread").alias(f"{c}_spread") for c in m])
    spark = posts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // PARTITION_ROWS))
    ordered = distinct.join(wide, "source", "left").repartitionByRange(parts, "source", "position").sortWithinPartitions("source", "position")
    blocks = materialise(ordered.withColumn("pid", F.spark_partition_id()))
    rows = [r.asDict() for r in blocks.mapInPandas(summarise(params), SUMMARY).collect()]  # one row a partition
    around = spark.sparkContext.broadcast(contexts(rows, params))  # one entry a partition
    return blocks.mapInPandas(flag(params, around), FLAGS)


def implausible_posts(posts: DataFrame, source: str = "channel_id", position: str = "msg_id", params: SpikeParams = SpikeParams()) -> DataFrame:
    """Posts with a number that cannot be: the exact rules on what the model flagged and on every number that they may take."""
    flags = flag_numbers(posts, source, position, params)
    big = F.col("value") >= params.least
    exact = F.col("impossible") | (big & ((F.col("value") >= params.times * F.col("median")) | (F.col("run") >= params.run)))
    return flags.where(exact).select(F.col("source").alias(source), F.col("position").alias(position)).distinct()
