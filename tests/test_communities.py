"""The rounds of a seed on arrays: only what can move is judged, and what comes out is that of judging everything."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.operators import communities, derive
from tidewire.operators.communities import PATIENCE, PRIME, SLOWER, TIES, CommunityParams, drawn_number


def judging_all(a, b, w, seed, resolution):
    """Every node judged in every round, from the rules of ``modularity_runs``. A label for each node, and how many judgements were made."""
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    member, x, y, total, judged = np.arange(len(ids)), codes[: len(a)], codes[len(a) :], 2 * w.sum(), 0
    while True:
        n, weight = len(ids), np.zeros((len(ids), len(ids)))
        np.add.at(weight, (x, y), w)
        np.add.at(weight, (y, x), w)
        degree, apart = weight.sum(1), weight * (1 - np.eye(n))
        home, best, turn, ties = np.arange(n), None, 0, drawn_number(seed, ids, TIES, np.mod)
        while True:
            into = np.eye(n)[home]
            links, near = apart @ into, (apart > 0) @ into > 0
            mass, own = np.bincount(home, degree, n), into > 0
            q = (links[own] - resolution * degree * mass[home] / total).sum()
            gain = np.where(near | own, np.round(links - resolution * degree[:, None] * (mass - own * degree[:, None]) / total, 9), -np.inf)
            rank = np.where(gain == gain.max(1, keepdims=True), np.where(own, PRIME, ties) * n + np.arange(n), -1)
            to, judged = rank.argmax(1), judged + n
            if best is None or q > best[0] + 1e-9 * total:
                best, kept = (q, turn), home
            if (to == home).all() or turn - best[1] >= PATIENCE:
                break
            home = np.where(drawn_number(seed, ids, turn, np.mod) % 2 ** (1 + turn // SLOWER) == 0, to, home)
            turn += 1
        if not best[1]:
            return member, judged
        left, home = np.unique(kept, return_inverse=True)
        ids, member, x, y = ids[left], home[member], home[x], home[y]


def graph(seed):
    """Twelve loose groups with links between them, weights of many digits and a hub that a third of all nodes link to."""
    rng = np.random.default_rng(seed)
    pairs = {(a, b) for a in range(240) for b in range(a + 1, 240) if rng.random() < (0.25 if a // 20 == b // 20 else 0.015) or (a == 0 and b % 3 == 0)}
    a, b = np.array(sorted(pairs)).T
    return a * 1_000_003 + 7, b * 1_000_003 + 7, rng.random(len(a)) + 0.1


@pytest.mark.parametrize("resolution", [0.5, 1.6, 4.0])
@pytest.mark.parametrize("block", [1 << 17, 50])
def test_few_nodes_are_judged_with_the_same_end(monkeypatch, resolution, block):
    judged, real = [], communities.chosen
    monkeypatch.setattr(communities, "BLOCK", block)
    monkeypatch.setattr(communities, "chosen", lambda nodes, *rest: judged.append(len(nodes)) or real(nodes, *rest))
    every = 0
    for seed in range(6):
        a, b, w = graph(seed)
        member = communities.settled(*communities.coded(a, b, w), seed, resolution)
        want, n = judging_all(a, b, w, seed, resolution)
        every += n
        assert (np.unique(member, return_inverse=True)[1] == np.unique(want, return_inverse=True)[1]).all()
    assert sum(judged) < 0.3 * every


def test_sorted_keys_keep_the_order_of_equal_ones():
    keys = np.array([5, 1, 5, 0, 1, 5])
    for most in (6, 1 << 62):  # the second leaves no bits for the places
        values, order = communities.ordered(keys, most)
        assert values.tolist() == [0, 1, 1, 5, 5, 5] and order.tolist() == [3, 1, 4, 0, 2, 5]
    assert communities.ordered(keys[:0], 6)[1].tolist() == []


def test_partition_counts_the_mates_of_every_run(spark):
    """What the tasks of several seeds add up is what ``with_stability`` counts over the rows of all runs."""
    a, b, w = graph(9)
    df = spark.createDataFrame([(int(x), int(y), float(z)) for x, y, z in zip(a, b, w)] + [(int(b[0]), int(b[0]), 1.0)], "a bigint, b bigint, weight double")
    graph_of = communities.coded(a, b, w)
    runs = [(s, int(n), int(c)) for s in range(7) for n, c in zip(graph_of[0], communities.named(graph_of[0], communities.settled(*graph_of, s, 1.6)))]
    plain = communities.with_stability(spark.createDataFrame(runs, "seed int, node bigint, community bigint"), 0)
    want = sorted(map(tuple, communities.connected(plain, df).collect()))
    got = sorted(map(tuple, communities.partition(df, CommunityParams(seeds=tuple(range(7)))).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
    assert len({r[1] for r in got}) > 3 and min(r[2] for r in got) < 1


def shuffled(spark):
    """Bytes written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_no_copy_of_the_graph_is_shuffled_for_the_seeds(spark):
    rng = np.random.default_rng(4)
    a, b = np.unique(np.sort(rng.integers(0, 900, (24_000, 2)), axis=1), axis=0).T
    df = communities.materialise(spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "weight": rng.random(len(a)) + 0.1})))
    before = shuffled(spark)
    got = communities.partition(df, CommunityParams(seeds=tuple(range(6))))
    assert got.count() == 900 and shuffled(spark) - before < 8 * len(a)


def test_stored_pairs_are_those_of_three_steps_moved_once(spark, rows):
    day, far = datetime(2026, 7, 1), datetime(2025, 1, 1)
    odd = [
        (1000000001, 1000000002, "forward", 5, 7, day), (-1001000000001, 1000000002, "forward", 5, 7, far), (1000000002, -1001000000001, "forward", 5, 7, day),  # one twice, and its opposite
        (1000000001, 1000000002, "mention", 5, None, day), (1000000001, 1000000002, "mention", 5, None, day), (1000000001, 1000000002, "mention", 6, None, far),
        (1000000003, 1000000003, "mention", 1, None, day), (1000000003, -1001000000003, "mention", 2, None, day), (None, 1000000001, "mention", 3, None, day), (1000000001, None, "forward", 3, None, day),
        (1000000004, 1000000001, None, 1, None, day), (1000000004, 1000000002, None, 1, None, day), (1000000004, 1000000002, "forward", 1, None, day), (1000000003, 1000000005, "mention", 1, None, None),
    ]
    rng = np.random.default_rng(5)
    many = [(1000000010 + int(x), 1000000010 + int(y), "forward" if k else "mention", i, None, day) for i, (x, y, k) in enumerate(zip(rng.integers(0, 300, 20_000), rng.integers(0, 300, 20_000), rng.random(20_000) < 0.7))]
    edges = spark.createDataFrame([(*r, None, None) for r in odd + many], "src_channel_id bigint, dst_channel_id bigint, kind string, msg_id bigint, dst_msg_id bigint, published_at timestamp, dst_published_at timestamp, grouped_id bigint")
    edges = communities.materialise(edges.withColumn("derived_at", F.col("published_at")))
    now, written = F.to_timestamp(F.lit("2026-08-01")), []
    for pairs in (lambda: communities.balanced_pairs(communities.decayed_pairs(derive.distinct_edges(edges), now)), lambda: communities.stored_pairs(edges, now)):
        before = shuffled(spark)
        written.append((rows(pairs().fillna(0.0, "weight"), "a", "b", "weight"), shuffled(spark) - before))
    (want, three), (got, one) = written
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
    assert (1000000001, 1000000002) in [r[:2] for r in got] and one < 0.7 * three


def test_parts_of_communities_in_arrays():
    a, b = np.array([1, 2, 5, 6, 2, 8]), np.array([2, 3, 6, 7, 6, 9])
    ids, around, _ = communities.coded(a, b, np.ones(6))
    home = np.array([0, 0, 0, 0, 0, 1, 2, 2])  # of 1, 2, 3, 5, 6, 7, 8, 9
    assert ids[communities.held_together(around, home)].tolist() == [1, 1, 1, 1, 1, 7, 8, 8]
    assert ids[communities.held_together(around, np.array([0, 0, 0, 1, 0, 1, 2, 2]))].tolist() == [1, 1, 1, 5, 1, 7, 8, 8]
