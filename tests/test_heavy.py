from __future__ import annotations

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.operators import heavy, references

EDGE = "src_channel_id bigint, msg_id bigint, kind string, dst_channel_id bigint, dst_msg_id bigint, task int, shards int"


def edges(seed=0, n=1500):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        dst = 7 if rng.random() < 0.35 else int(rng.integers(100, 160))
        src = 9 if rng.random() < 0.3 else int(rng.integers(100, 160))
        out.append((src, int(rng.integers(0, 40)), str(rng.choice(["forward", "mention"])), dst, None if rng.random() < 0.4 else int(rng.integers(0, 5)), 1, 2))
    out += out[:100]
    return out


CHANNELS = [(7, "author", 1), (7, "aggregator", 2), (-1000000000009, None, 3), (120, "media", 4), (None, "media", 5)]


def channels(spark):
    return spark.createDataFrame(CHANNELS, "tg_id bigint, kind string, task int")


def expected(data):
    keys = {(s, m, k, d, x) for s, m, k, d, x, *_ in data}
    out = {}
    for side, at in (("src", 0), ("dst", 3)):
        with_end = [k for k in keys if k[at] is not None]
        for key in with_end:
            n, f = out.get((side, key[at]), (0, 0))
            out[side, key[at]] = n + 1, f + (key[2] == "forward")
    return out


def test_counts_equal_plain_counts(spark):
    data = [*edges(), (None, 1, "forward", 5, 1, 0, 0), (5, 1, "forward", None, 1, 0, 0)]
    got = {(r["side"], r["channel_id"]): (r["refs"], r["forwards"]) for r in references.reference_counts(spark.createDataFrame(data, EDGE), channels(spark)).collect()}
    assert got == expected(data)


def test_inventory_rows_reach_every_shard(spark, rows):
    got = references.reference_counts(spark.createDataFrame(edges(), EDGE), channels(spark)).where("channel_id in (7, 9, 120, 121)")
    assert rows(got, "channel_id", "kind", "known", "side")[:4] == [(7, "aggregator", True, "dst"), (9, None, True, "src"), (120, "media", True, "dst"), (120, "media", True, "src")]
    assert rows(got.where("channel_id = 121"), "kind", "known") == [(None, False), (None, False)]


def test_heavy_channels_and_both_id_forms(spark, rows):
    data = [(1100000001 if i % 2 else -1001100000001, i, "forward", 1100000100 + i, 1, 0, 0) for i in range(60)]
    data += [(1100000001, i, "forward", 1100000100 + i, 1, 0, 0) for i in range(60)]
    found = references.heavy_channels(spark.createDataFrame(data, EDGE), channels(spark), 0.5)
    assert rows(found) == [("src", 1100000001)]


def test_empty(spark, rows):
    assert rows(references.reference_counts(spark.createDataFrame([], EDGE), channels(spark).limit(0))) == []


@given(st.dictionaries(st.integers(0, 50), st.integers(100, 10_000), max_size=12), st.lists(st.integers(0, 50), min_size=8, max_size=64), st.integers(1, 8))
def test_packing_is_whole_and_even(loads, buckets, tasks):
    plan = heavy.pack(loads, buckets, tasks)
    total = sum(loads.values()) + sum(buckets)
    assert set(plan.heavy) == set(loads)
    assert all(0 <= t < tasks for t in [*plan.light, *[t for s in plan.heavy.values() for t in s]])
    assert abs(sum(plan.load) - total) <= tasks
    assert max(plan.load) <= 2 * max(1, total / tasks) + max(buckets) + 1


def test_shards_spread_a_heavy_key(spark):
    df = spark.createDataFrame(edges(), EDGE).drop("task", "shards")
    plan = heavy.plan_loads(df, "dst_channel_id", 4)
    assert len(plan.heavy[7]) > 1
    sizes = [r["count"] for r in heavy.fragment(df, "dst_channel_id", ["src_channel_id", "msg_id", "kind", "dst_msg_id"], plan).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.5 * sum(sizes)


def test_join_equals_plain_join(spark):
    df = spark.createDataFrame(edges(3), EDGE).drop("task", "shards")
    names = spark.createDataFrame([(i, f"n{i}") for i in [7, *range(100, 150)]], "dst_channel_id bigint, name string")
    plan = heavy.plan_loads(df, "dst_channel_id", 4)
    got = heavy.fragment_join(df, names, "dst_channel_id", ["src_channel_id", "msg_id"], plan)
    plain = df.join(names, "dst_channel_id")
    kept = heavy.fragment_join(df, names, "dst_channel_id", ["src_channel_id", "msg_id"], plan, "left")
    assert kept.count() == df.where("dst_channel_id is not null").count()
    assert got.count() == plain.count()
    assert got.select(*plain.columns).exceptAll(plain).count() == 0
