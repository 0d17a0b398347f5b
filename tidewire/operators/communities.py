"""Communities of the reference graph, their quality and their relations."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.ids import bare_id
from tidewire.functions.timing import decay
from tidewire.operators.derive import KEY
from tidewire.operators.families import closure
from tidewire.session import materialise


@dataclass(frozen=True)
class CommunityParams:
    half_life_days: float = 180.0
    resolution: float = 1.6
    local_edges: int = 6_000_000  # a task that codes a graph takes about 120 bytes a pair, one that runs seeds as much at its peak
    seeds: tuple[int, ...] = tuple(range(50))  # the first gives the partition, all of them its stability


def decayed_pairs(edges: DataFrame, now: Column, half_life_days: float = 180.0) -> DataFrame:
    """src, dst, kind, weight (halving with age), n."""
    rows = edges.withColumn("w", decay(now, F.col("published_at"), half_life_days))
    return rows.groupBy(F.col("src_channel_id").alias("src"), F.col("dst_channel_id").alias("dst"), "kind").agg(F.sum("w").alias("weight"), F.count("*").alias("n"))


def balanced_pairs(decayed: DataFrame) -> DataFrame:
    """a, b, weight: undirected pairs, kinds scaled to equal mass, the sum damped by a square root."""
    pairs = materialise(decayed.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind").agg(F.sum("weight").alias("w")))  # read three times
    mass = pairs.groupBy("kind").agg(F.sum("w").alias("m"))  # one row a kind
    top = mass.agg(F.max("m").alias("top"))
    scaled = pairs.join(F.broadcast(mass.crossJoin(top)), "kind").withColumn("w", F.col("w") * F.col("top") / F.col("m"))
    return scaled.groupBy("a", "b").agg(F.sqrt(F.sum("w")).alias("weight"))


def stored_pairs(edges: DataFrame, now: Column, half_life_days: float = 180.0) -> DataFrame:
    """a, b, weight of stored edges: ``balanced_pairs`` of ``decayed_pairs`` of ``derive.distinct_edges``, moved once.

    All rows of a pair meet before the first step and stay together, so no step between is shuffled or kept. Undated edges weigh nothing.
    """
    src, dst = bare_id("src_channel_id"), bare_id("dst_channel_id")
    rows = edges.select(*KEY, "published_at").withColumn("src_channel_id", src).withColumn("dst_channel_id", dst).where("src_channel_id <> dst_channel_id")
    met = rows.withColumn("a", F.least("src_channel_id", "dst_channel_id")).withColumn("b", F.greatest("src_channel_id", "dst_channel_id")).repartition("a", "b")
    once = met.groupBy("a", "b", *KEY).agg(F.min("published_at").alias("published_at"))
    pairs = once.groupBy("a", "b", "kind").agg(F.sum(decay(now, F.col("published_at"), half_life_days)).alias("w"))
    mass = pairs.groupBy("kind").agg(F.sum("w").alias("m")).agg(F.collect_list(F.struct("kind", "m")).alias("all"), F.max("m").alias("top"))  # one row
    own = F.get(F.filter("all", lambda x: x["kind"] == F.col("kind")), 0)["m"]  # no join by kind: a condition on one side only would part the plans, and each would shuffle
    scaled = pairs.crossJoin(F.broadcast(mass)).withColumn("w", F.when(F.col("kind").isNotNull(), F.coalesce(F.col("w") * F.col("top") / own, F.lit(0.0))))
    return scaled.groupBy("a", "b").agg(F.sqrt(F.sum("w")).alias("weight")).where("weight is not null")  # of no kind but null


def propagate(pairs: DataFrame) -> DataFrame:
    """node, community by weighted label propagation: a node takes the heaviest label around it, the least of equal ones, where that outweighs its own.

    Nodes move in rounds, about half of them at a time by a draw of its own each round, so that neighbours cannot swap labels
    for ever; the end is a round in which no node, drawn or not, would move. Labels are summed by (node, label) with
    map-side combine, so a node with a third of all edges gathers at most its distinct labels.
    """
    both = materialise(pairs.select("a", "b", "weight").union(pairs.select("b", "a", "weight")).toDF("node", "other", "weight"))
    labels = materialise(both.select("node").distinct().withColumn("label", F.col("node")))
    turn = 0
    while True:
        votes = both.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label", "weight", F.lit(False).alias("own"))
        votes = votes.union(labels.select("node", "label", F.lit(0.0), F.lit(True))).groupBy("node", "label").agg(F.round(F.sum("weight"), 9).alias("w"), F.max("own").alias("own"))
        mine = lambda c: F.max(F.when(F.col("own"), F.col(c)))
        best = votes.groupBy("node").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("t"), mine("w").alias("mine"), mine("label").alias("own"))
        wants = F.col("t.w") > F.col("mine")
        drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        moved = materialise(best.select("node", F.when(wants & drawn, -F.col("t.l")).otherwise(F.col("own")).alias("label"), wants.alias("wants")))
        labels = moved.select("node", "label")
        if not moved.where("wants").limit(1).count():
            return labels.withColumnRenamed("label", "community")
        turn += 1


PRIME = 2_147_483_629


def drawn_number(seed: Column | int, node: Column | np.ndarray, turn: int, mod=F.pmod):
    """A number below ``PRIME`` for a seed, node and turn, the same in SQL and in numpy; no product leaves 63 bits."""
    x = mod(mod(node, PRIME) * 48271 + seed * 16807 + (turn * 69621 + 12345), PRIME)
    x = mod(mod(x * x, PRIME) * 40014 + seed + 1, PRIME)
    return mod(x * x, PRIME)


TIES, PATIENCE, SLOWER = 1_000_003, 6, 8


#: Entries that are judged at once, so that their arrays stay in a core's cache.
BLOCK = 1 << 17


def remainder(x: np.ndarray, by: int) -> np.ndarray:
    """As ``np.mod``; dividing by a constant takes a fraction of its time."""
    return x - x // by * by


def ordered(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys below ``most`` and where each comes from, equal ones in their order; one sort of key and place together if 63 bits hold both."""
    bits = len(keys).bit_length()
    if most << bits < 1 << 63:
        both = keys.astype(np.int64)
        both <<= bits
        both |= np.arange(len(keys))
        both.sort()
        order = both & (1 << bits) - 1
        both >>= bits
        return both, order
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where each distinct one of sorted keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])


def merged(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Undirected pairs of codes below ``n``, the lesser first, in order and each once with its sum."""
    shift = n.bit_length()
    keys, order = ordered(np.minimum(x, y).astype(np.int64) << shift | np.maximum(x, y), n << shift)
    heads = firsts(keys)
    keys = keys[heads]
    return (keys >> shift).astype(x.dtype), (keys & (1 << shift) - 1).astype(x.dtype), np.add.reduceat(w[order], heads) if len(heads) else w


def neighbours(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the entries of each node begin, their other ends and weights; the first of a node is itself, with weight 0."""
    apart = x != y
    if not apart.all():
        x, y, w = x[apart], y[apart], w[apart]
    own = np.arange(n, dtype=x.dtype)
    order = ordered(np.concatenate([own, x, y]), n)[1]
    begin = np.concatenate([[0], np.cumsum(1 + np.bincount(x, minlength=n) + np.bincount(y, minlength=n))])
    return begin, np.concatenate([own, y, x])[order], np.concatenate([np.zeros(n), w, w])[order]


def coded(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray]:
    """Sorted nodes, the neighbours of each by their places, and the weight at each: what the runs of all seeds begin with."""
    ids = np.unique(np.concatenate([a, b]))
    n, code = len(ids), np.int32 if len(ids) < 1 << 31 else np.int64
    x, y, w = merged(np.searchsorted(ids, a).astype(code), np.searchsorted(ids, b).astype(code), w, n)
    return ids, neighbours(x, y, w, n), np.bincount(x, w, n) + np.bincount(y, w, n)


def entries(nodes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of some nodes, one node after the other: the place among ``nodes``, and among all entries."""
    size = begin[nodes + 1] - begin[nodes]
    row = np.repeat(np.arange(len(nodes)), size)
    return row, np.arange(len(row)) + (begin[nodes] - np.cumsum(size) + size)[row]


def contracted(around: tuple, home: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The neighbours of ``n`` communities from those of their nodes, some communities at a time."""
    begin, other, w = around
    nodes = ordered(home, n)[1]
    ends = np.cumsum(np.bincount(home, minlength=n))
    block = np.cumsum((begin[1:] - begin[:-1])[nodes])[ends - 1] // BLOCK
    shift, done, full, rows, others, weights = n.bit_length(), 0, 0, np.zeros(n, np.int64), np.empty_like(other), np.empty_like(w)  # pages that stay empty take no memory
    for first in np.flatnonzero(np.diff(block, append=-1)):  # the last community of each block
        some = nodes[done : (done := ends[first])]
        low = home[some[0]]
        row, at = entries(some, begin)
        row, to = home[some][row], home[other[at]]
        keys, order = ordered((row - low).astype(np.int64) << shift | to, int(first - low + 1) << shift)
        heads = firsts(keys)
        keys, end = keys[heads], full + len(heads)
        rows[low : first + 1] = np.bincount(keys >> shift)
        others[full:end] = keys & (1 << shift) - 1
        weights[full:end] = np.add.reduceat(np.where(row == to, 0.0, w[at])[order], heads)
        full = end
    return np.concatenate([[0], np.cumsum(rows)]), others[:full], weights[:full]


def held_together(around: tuple, home: np.ndarray) -> np.ndarray:
    """The least node of the connected part of its community that each node lies in."""
    begin, other, _ = around
    label, inside = np.arange(len(home)), []
    for low in range(0, len(home), BLOCK):
        row, at = entries(np.arange(low, min(low + BLOCK, len(home))), begin)
        row, to = row + low, other[at]
        kept = (row < to) & (home[row] == home[to])
        inside.append((row[kept].astype(other.dtype), to[kept]))
    x, y = (np.concatenate(end) for end in zip(*inside))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return label
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))  # labels are least nodes of parts, which are joined here
        while (label[label] != label).any():
            label = label[label]


def chosen(nodes: np.ndarray, around: tuple, home: np.ndarray, degree: np.ndarray, mass: np.ndarray, ties: np.ndarray, pull: float) -> tuple[np.ndarray, np.ndarray]:
    """The community of most gain for each of ``nodes``, its own before others of equal gain, then by draw; and how far any other lies below."""
    begin, other, w = around
    shift = len(home).bit_length()
    mask, to, ahead = (1 << shift) - 1, home[nodes], np.empty(len(nodes))
    block = np.cumsum(begin[nodes + 1] - begin[nodes]) // BLOCK
    cuts = [*firsts(block).tolist(), len(nodes)]
    for low, high in zip(cuts, cuts[1:]):
        some = nodes[low:high]
        row, at = entries(some, begin)
        keys = row << shift
        keys |= home[other[at]]
        keys, order = ordered(keys, len(some) << shift)
        heads = firsts(keys)
        keys = keys[heads]
        links = np.add.reduceat(w[at[order]], heads)
        row, c = keys >> shift, keys & mask
        heads = firsts(row)
        own = np.flatnonzero(c == to[low:high][row])  # one a row, by the entry of the node itself
        mine, rest = degree[some], mass[c]
        rest[own] -= mine
        rest *= (mine * pull)[row]
        links -= rest
        links *= 1e9
        gain = np.rint(links, out=links)
        stay = gain[own]
        gain[own] = -np.inf
        most = np.maximum.reduceat(gain, heads)
        ahead[low:high] = stay - np.maximum(most, 0)  # a community without links gains 0 at most
        wants = np.flatnonzero(most > stay)
        if len(wants):
            size = np.diff(heads, append=len(row))[wants]
            row = np.repeat(np.arange(len(wants)), size)
            at = np.arange(len(row)) + (heads[wants] - np.cumsum(size) + size)[row]
            gain, c = gain[at], c[at]
            best = np.flatnonzero(gain == most[wants][row])
            to[low + wants] = goal = np.maximum.reduceat(ties[c[best]] << shift | c[best], firsts(row[best])) & mask
            gain[best[c[best] == goal[row[best]]]] = -np.inf
            second = np.maximum.reduceat(gain, firsts(row))
            ahead[low + wants] = most[wants] - np.maximum(np.maximum(second, stay[wants]), 0)
    return to, ahead / 1e9


def settled(ids: np.ndarray, around: tuple, degree: np.ndarray, seed: int, resolution: float) -> np.ndarray:
    """``modularity_runs`` for one seed in one task: the same rounds, draws and ends on the arrays of ``coded``. A label for each of ``ids``.

    Only drawn nodes are judged, as no other can move, and of these only the ones that may want to: a judged node keeps how far its
    community lies ahead of any other, less what moves of neighbours and changes of mass can have taken from that since.
    The weight inside communities follows from the moves. Where no node would move, the rounds end by patience with the same best one.
    """
    member, total = np.arange(len(ids)), degree.sum()
    while total:
        n, pull = len(ids), resolution / total
        home, inside, best, turn = np.arange(n, dtype=around[1].dtype), 0.0, None, 0
        ties = drawn_number(seed, ids, TIES, remainder)
        mass, lost = degree, 0.0  # lost: what a community lost of its mass at most, summed over the rounds
        ahead, then, since = np.full(n, -np.inf), np.zeros(n), np.zeros(n)  # as judged last, with the mass of the rest of its community and ``lost`` then
        while True:
            q = inside - pull * (mass * mass).sum()
            if best is None or q > best[0] + 1e-9 * total:
                best, kept = (q, turn), home
            if turn - best[1] >= PATIENCE:
                break
            drawn = np.flatnonzero(drawn_number(seed, ids, turn, remainder) & (1 << 1 + turn // SLOWER) - 1 == 0)
            taken = pull * degree[drawn] * (mass[home[drawn]] - degree[drawn] - then[drawn] + lost - since[drawn])
            drawn = drawn[ahead[drawn] - taken < 1e-8]
            to, ahead[drawn] = chosen(drawn, around, home, degree, mass, ties, pull)
            moves = to != home[drawn]
            then[drawn], since[drawn] = mass[to] - np.where(moves, 0, degree[drawn]), lost
            if moves.any():
                drawn, to, before, home = drawn[moves], to[moves], home, home.copy()
                home[drawn] = to
                row, at = entries(drawn, around[0])
                other, weight = around[1][at], around[2][at]
                was, now, out, into = before[other], home[other], before[drawn][row], to[row]
                joins = now == into
                inside += (weight * (joins.astype(float) - (was == out)) * (2.0 - (was != now))).sum()  # a pair of two that move has both its entries here
                ahead += np.bincount(other, weight * (2.0 * joins - 1.0 - (now == out)), n)
                fresh = np.bincount(home, degree, n)
                lost, mass = lost + max((mass - fresh).max(), 0.0), fresh
            turn += 1
        if not best[1]:
            break
        left, home = np.unique(kept, return_inverse=True)
        ids, member, degree = ids[left], home[member], np.bincount(home, degree)
        around = contracted(around, home, len(ids))
    return member


def modularity_runs(pairs: DataFrame, p: CommunityParams = CommunityParams()) -> DataFrame:
    """seed, node, community (its least node) for every seed by distributed greedy modularity moves, then the same on merged communities.

    All seeds move in the same rounds. In a round about half of the nodes, drawn by seed and round, take the neighbouring
    community of most gain, judged by the labels before the round; the drawn share halves every eight rounds, so that moves
    made at once cannot undo each other for ever. A seed's level ends when no node would move, or when its modularity has
    not grown for six rounds, and keeps its best round; a seed ends with a level that gains nothing. The driver sees one row a seed and round.
    """
    seeds = pairs.sparkSession.createDataFrame([(int(s),) for s in p.seeds], "seed int")
    flat = materialise(pairs.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("weight").cast("double").alias("w")))
    total = 2 * (flat.agg(F.sum("w")).first()[0] or 0.0)
    alone = flat.select(F.explode(F.array("a", "b")).alias("node")).distinct().crossJoin(F.broadcast(seeds))
    member = materialise(alone.select("seed", "node", F.col("node").alias("at")))
    edges, of, active = flat, [], [int(s) for s in p.seeds] if total else []
    while active:
        both = materialise(edges.where("a <> b").select(*of, F.col("a").alias("node"), F.col("b").alias("other"), "w").union(edges.where("a <> b").select(*of, F.col("b").alias("node"), F.col("a").alias("other"), "w")))
        loops = edges.where("a = b").select(*of, F.col("a").alias("node"), (2 * F.col("w")).alias("w"))
        degree = both.select(*of, "node", "w").union(loops).groupBy(*of, "node").agg(F.sum("w").alias("degree"))
        if not of:
            degree = degree.crossJoin(F.broadcast(seeds))
        state = materialise(degree.select("seed", "node", F.col("node").alias("home"), F.col("node").alias("kept"), "degree"))
        best: dict[int, tuple[float, int]] = {}
        live, turn = list(active), 0
        while live:
            now = state.where(F.col("seed").isin(live))
            mass = now.groupBy("seed", "home").agg(F.sum("degree").alias("mass"))
            links = both.join(now.select("seed", F.col("node").alias("other"), F.col("home").alias("c")), [*of, "other"]).groupBy("seed", "node", "c").agg(F.sum("w").alias("w"))
            stay = now.select("seed", "node", F.col("home").alias("c"), F.lit(0.0).alias("w"))
            offers = links.union(stay).groupBy("seed", "node", "c").agg(F.sum("w").alias("w")).join(mass.withColumnRenamed("home", "c"), ["seed", "c"]).join(now, ["seed", "node"])
            own = F.col("c") == F.col("home")
            gain = F.col("w") - p.resolution * F.col("degree") * (F.col("mass") - F.when(own, F.col("degree")).otherwise(0.0)) / total
            order = F.struct(F.round(gain, 9).alias("gain"), own.alias("own"), drawn_number(F.col("seed").cast("long"), F.col("c"), TIES).alias("draw"), F.col("c"))
            quality = F.max(F.when(own, F.col("w") - p.resolution * F.col("degree") * F.col("mass") / total))
            chosen = offers.groupBy("seed", "node", "home", "kept", "degree").agg(F.max(order)["c"].alias("to"), quality.alias("q"))
            drawn = F.pmod(drawn_number(F.col("seed").cast("long"), F.col("node"), turn), 2 ** (1 + turn // SLOWER)) == 0
            wants = F.col("to") != F.col("home")
            moved = materialise(chosen.select("seed", "node", F.col("home").alias("before"), F.when(drawn, F.col("to")).otherwise(F.col("home")).alias("home"), "kept", "degree", wants.cast("int").alias("wants"), "q"))
            rest, better = state.where(~F.col("seed").isin(live)), [-1]
            for r in moved.groupBy("seed").agg(F.sum("wants").alias("wants"), F.sum("q").alias("q")).collect():
                if r["seed"] not in best or r["q"] > best[r["seed"]][0] + 1e-9 * total:
                    best[r["seed"]] = (r["q"], turn)
                    better.append(r["seed"])
                if not r["wants"] or turn - best[r["seed"]][1] >= PATIENCE:
                    live.remove(r["seed"])
            state = materialise(rest.union(moved.select("seed", "node", "home", F.when(F.col("seed").isin(better), F.col("before")).otherwise(F.col("kept")).alias("kept"), "degree")))
            turn += 1
        active = [s for s in active if best[s][1]]  # the others were best before anything moved
        if not active:
            break
        homes = state.where(F.col("seed").isin(active)).select("seed", F.col("node").alias("at"), F.col("kept").alias("home"))
        member = materialise(member.join(homes, ["seed", "at"], "left").select("seed", "node", F.coalesce("home", "at").alias("at")))
        end = lambda name: state.where(F.col("seed").isin(active)).select("seed", F.col("node").alias(name), F.col("kept").alias(f"home_{name}"))  # noqa: B023, E731
        placed = edges.join(end("a"), [*of, "a"]).join(end("b"), ["seed", "b"])
        merged = placed.groupBy("seed", F.least("home_a", "home_b").alias("a"), F.greatest("home_a", "home_b").alias("b")).agg(F.sum("w").alias("w"))
        edges, of = materialise(merged), ["seed"]
    least = member.groupBy("seed", "at").agg(F.min("node").alias("community"))
    return member.join(least, ["seed", "at"]).select("seed", "node", "community")


def connected(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labels (node, community, ...) with every community split into the parts that pairs inside it connect, each named for its least node."""
    home = labels.select("node", "community")
    within = pairs.join(home.toDF("a", "ca"), "a").join(home.toDF("b", "cb"), "b").where("ca = cb")
    parts = closure(within).toDF("node", "part")
    rest = [c for c in labels.columns if c not in ("node", "community")]
    return labels.join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("community"), *rest)


#: Numbers in a row of arrays that go through Spark.
CHUNK = 1 << 17


def rows_of(name: str, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """An array as rows (name, chunk, data)."""
    for chunk, low in enumerate(range(0, len(x), CHUNK)):
        yield pa.RecordBatch.from_pydict({"name": [name], "chunk": pa.array([chunk], pa.int32()), "data": [x[low : low + CHUNK].tobytes()]})


ROWS = "name string, chunk int, data binary"


def packed(pairs: DataFrame) -> DataFrame:
    """n, data: the pairs of different ends, many to a row, 24 bytes each."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            data = b"".join(x.column(i).to_numpy(zero_copy_only=False).tobytes() for i in range(3) for x in held)
            return pa.RecordBatch.from_pydict({"n": pa.array([sum(map(len, held))], pa.int32()), "data": [data]})

        for x in batches:
            held.append(x.filter(pc.not_equal(x.column(0), x.column(1))))  # here: a condition of the plan would reach below the shuffle that ``stored_pairs`` reads twice
            if sum(map(len, held)) >= CHUNK:
                yield row()
                held.clear()
        if sum(map(len, held)):
            yield row()

    rows = pairs.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("weight").cast("double"))
    return materialise(rows.mapInArrow(pack, "n int, data binary"))


def unpacked(kept: DataFrame) -> DataFrame:
    """a, b, weight of the rows of ``packed``."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for n, data in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, t, n, 8 * n * i)) for i, t in enumerate((np.int64, np.int64, np.float64))], ["a", "b", "weight"])

    return kept.mapInArrow(unpack, "a long, b long, weight double")


def partition(pairs: DataFrame, p: CommunityParams = CommunityParams()) -> DataFrame:
    """node, community (its least node), stability: one method, greedy modularity in rounds, for graphs of every size.

    A community that is not connected by its own pairs is split into its connected parts, so each one holds together.

    A graph of at most ``local_edges`` pairs makes the rounds of a seed in one task, a larger one over the cluster; rounds, draws
    and ends are the same, so this choice does not change what comes out. One task codes the graph and runs the first seed; the
    tasks of the others read the same copy of its arrays where it lies, nothing of the graph is shuffled for them.
    """
    kept = packed(pairs)
    size = kept.agg(F.sum("n")).first()[0] or 0
    if size > p.local_edges:
        whole = materialise(unpacked(kept))
        return connected(with_stability(materialise(modularity_runs(whole, p)), p.seeds[0]), whole)
    empty = pairs.sparkSession.createDataFrame([], "node long, community long, stability double")
    if not size:
        return empty

    def base(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, w, done = np.empty(size, np.int64), np.empty(size, np.int64), np.empty(size), 0
        for x in batches:
            for n, data in zip(x.column(0).to_pylist(), x.column(1)):
                for i, to in enumerate((a, b, w)):
                    to[done : done + n] = np.frombuffer(data.as_buffer(), to.dtype, n, 8 * n * i)
                done += n
        ids, around, degree = coded(a, b, w)
        del a, b, w
        home = np.unique(settled(ids, around, degree, p.seeds[0], p.resolution), return_inverse=True)[1]
        for name, x in (("sizes", np.array([len(ids), len(around[1])])), ("node", ids), ("community", ids[held_together(around, home)]), ("home", home), ("begin", around[0]), ("other", around[1]), ("weight", around[2]), ("degree", degree)):
            yield from rows_of(name, x)

    built = materialise(kept.coalesce(1).mapInArrow(base, ROWS))
    parts = min(len(p.seeds) - 1, pairs.sparkSession.sparkContext.defaultParallelism)

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, done, part = {}, defaultdict(int), -1
        for x in batches:
            for name, data, part in zip(x.column(0).to_pylist(), x.column(1), x.column(2).to_pylist()):  # noqa: B020
                if name == "sizes":
                    n, m = np.frombuffer(data.as_buffer(), np.int64)
                    code = np.int32 if n < 1 << 31 else np.int64
                    arrays = {"node": np.empty(n, np.int64), "home": np.empty(n, np.int64), "begin": np.empty(n + 1, np.int64), "other": np.empty(m, code), "weight": np.empty(m), "degree": np.empty(n)}
                else:
                    some = np.frombuffer(data.as_buffer(), arrays[name].dtype)
                    arrays[name][done[name] : done[name] + len(some)] = some
                    done[name] += len(some)
        if not arrays:
            return
        ids, home, degree, around = arrays["node"], arrays["home"], arrays["degree"], tuple(arrays[k] for k in ("begin", "other", "weight"))
        size, share = np.bincount(home)[home], np.zeros(len(ids))
        for seed in p.seeds[1 + part :: parts]:
            _, cell, n = np.unique(home * len(ids) + settled(ids, around, degree, seed, p.resolution), return_inverse=True, return_counts=True)
            share += np.where(size > 1, (n[cell] - 1) / np.maximum(size - 1, 1), 1.0)
        yield from rows_of("share", share)

    # the empty one keeps the copies apart: a union of single partitions alone is read by one task
    copies = [built.where("name <> 'community'").select("name", "data", F.lit(i).alias("part")) for i in range(parts)]
    shares = reduce(DataFrame.union, [*copies, pairs.sparkSession.createDataFrame([], "name string, data binary, part int")]).mapInArrow(others, ROWS)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        data = {name: list(rows) for name, rows in pdf.groupby("name")["data"]}
        node, community = (np.frombuffer(data[name][0], np.int64) for name in ("node", "community"))
        share = sum((np.frombuffer(x, np.float64) for x in data.get("share", [])), np.ones(len(node)))  # the first run keeps all of its own
        return pd.DataFrame({"node": node, "community": community, "stability": share / len(p.seeds)})

    return materialise(built.where("name in ('node', 'community')").union(shares).groupBy("chunk").applyInPandas(joined, empty.schema))


def named(ids: np.ndarray, member: np.ndarray) -> np.ndarray:
    """The least of ``ids``, which are sorted, with the same label."""
    _, first, label = np.unique(member, return_index=True, return_inverse=True)
    return ids[first[label]]


def with_stability(runs: DataFrame, base: int) -> DataFrame:
    """node, community, stability of the run of seed ``base`` among runs (seed, node, community).

    A node's stability is the share of its community-mates that a run keeps with it, averaged over all runs; a node alone
    in its community scores 1. Runs are counted by cells (base community, seed, run community), so no pairs are made.
    """
    first = runs.where(F.col("seed") == base).select("node", F.col("community").alias("base"))
    size = first.groupBy("base").agg(F.count("*").alias("size"))
    placed = runs.join(first, "node")
    cells = placed.groupBy("base", "seed", "community").agg(F.count("*").alias("n"))
    mates = F.when(F.col("size") > 1, (F.col("n") - 1) / (F.col("size") - 1)).otherwise(1.0)
    kept = placed.join(cells.join(size, "base").select("base", "seed", "community", mates.alias("kept")), ["base", "seed", "community"])
    return kept.groupBy("node", F.col("base").alias("community")).agg(F.avg("kept").alias("stability"))


def nmi(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: normalised mutual information of two partitions (node, community) over their common nodes; 1 if both are trivial."""
    both = left.select("node", F.col("community").alias("l")).join(right.select("node", F.col("community").alias("r")), "node")
    cells = both.groupBy("l", "r").agg(F.count("*").alias("n"))
    rows, columns, total = (cells.groupBy(*k).agg(F.sum("n").alias(name)) for k, name in ((["l"], "nl"), (["r"], "nr"), ([], "t")))
    h = lambda df, c: df.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))).alias(f"h_{c}"))
    info = cells.join(rows, "l").join(columns, "r").crossJoin(F.broadcast(total))
    mutual = info.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nl") * F.col("nr")))).alias("mi"))
    norm = F.sqrt(F.col("h_nl") * F.col("h_nr"))
    return mutual.crossJoin(h(rows, "nl")).crossJoin(h(columns, "nr")).select(F.when(norm > 0, F.col("mi") / norm).otherwise(F.lit(1.0)).alias("nmi"))


def labelled(decayed: DataFrame, labels: DataFrame) -> DataFrame:
    """Both ends of each pair with both communities: node, home, other, weight, kind."""
    at = lambda end, name: labels.select(F.col("node").alias(end), F.col("community").alias(name))
    rows = decayed.where("src <> dst").join(at("src", "cs"), "src").join(at("dst", "cd"), "dst")
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("cs").alias("home"), F.col("cd").alias("other")), F.struct(F.col("dst").alias("node"), F.col("cd").alias("home"), F.col("cs").alias("other")))
    return rows.select(F.explode(ends).alias("e"), "weight", "kind").select("e.node", "e.home", "e.other", "weight", "kind")


def inside_share(decayed: DataFrame, labels: DataFrame) -> DataFrame:
    """community, kind, inside: the share of square-rooted weight that stays inside."""
    rows = labelled(decayed, labels).withColumn("w", F.sqrt("weight"))
    inside = F.sum(F.when(F.col("home") == F.col("other"), F.col("w")).otherwise(0.0)) / F.sum("w")
    return rows.groupBy(F.col("home").alias("community"), "kind").agg(inside.alias("inside"))


def outward_lean(decayed: DataFrame, labels: DataFrame) -> DataFrame:
    """node, community, leans_to, lean: the foreign community with most of a node's outward weight, and its share of that."""
    rows = labelled(decayed, labels).where("home <> other").groupBy("node", "home", "other").agg(F.sqrt(F.sum("weight")).alias("w"))
    total = rows.groupBy("node").agg(F.sum("w").alias("t"))
    top = rows.groupBy("node", "home").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("other")).alias("o"))).alias("m"))
    return top.join(total, "node").select("node", F.col("home").alias("community"), (-F.col("m.o")).alias("leans_to"), (F.col("m.w") / F.col("t")).alias("lean"))


def bridges(decayed: DataFrame, labels: DataFrame, min_partners: int = 5) -> DataFrame:
    """Nodes with enough partners by how little of their weight stays inside."""
    rows = labelled(decayed, labels).groupBy("node", "home").agg(F.count("*").alias("partners"), (F.sum(F.when(F.col("home") == F.col("other"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("inside_share"))
    return rows.where(F.col("partners") >= min_partners).withColumnRenamed("home", "community").orderBy("inside_share", "node")


def community_sheet(labels: DataFrame, channels: DataFrame, members: int = 6) -> DataFrame:
    """community, size, top_kind, top_kind_n, members (the first usernames)."""
    rows = labels.join(channels.select(F.col("tg_id").alias("node"), "kind", "username"), "node", "left")
    kinds = rows.where("kind is not null").groupBy("community", "kind").agg(F.count("*").alias("n")).groupBy("community").agg(F.max_by("kind", F.struct("n", "kind")).alias("top_kind"), F.max("n").alias("top_kind_n"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy("username"))
    named = rows.where("username is not null").withColumn("r", rank).where(F.col("r") <= members).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "username"))), lambda s: s["username"]), ", ").alias("members"))
    return labels.groupBy("community").agg(F.count("*").alias("size")).join(kinds, "community", "left").join(named, "community", "left")


def term_odds(texts: DataFrame, group: str, text: str, top: int = 5, pattern: str = r"\p{L}{4,}", parts: float = 4, most_floor: int = 3) -> DataFrame:
    """The terms that set a group's texts apart: log odds of document frequency inside against outside, the first few.

    A term needs max(2, size/parts) documents of its group, at most ``most_floor``. Distinct terms a document.
    """
    docs = texts.where(f"{text} is not null and {group} is not null")
    terms = docs.select(group, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1)))).alias("term"))
    inside = terms.groupBy(group, "term").agg(F.count("*").alias("n"))
    everywhere = inside.groupBy("term").agg(F.sum("n").alias("all_n"))
    sizes = docs.groupBy(group).agg(F.count("*").alias("size"))
    total = docs.agg(F.count("*").alias("total"))
    rows = inside.join(everywhere, "term").join(sizes, group).crossJoin(F.broadcast(total))
    floor = F.least(F.lit(most_floor), F.greatest(F.lit(2), F.floor(F.col("size") / parts)))
    here = (F.col("n") + 0.5) / (F.col("size") - F.col("n") + 0.5)
    there = (F.col("all_n") - F.col("n") + 0.5) / (F.col("total") - F.col("size") - F.col("all_n") + F.col("n") + 0.5)
    scored = rows.where(F.col("n") >= floor).withColumn("odds", F.round(F.ln(here / there), 6))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("odds"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(group, "rank", "term", "n", "odds")


def graph_export(decayed: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of an export: explicit columns only."""
    edges = decayed.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("tg_id")).distinct()
    return ends.join(channels.select("tg_id", "username", "title", "kind"), "tg_id", "left"), edges
