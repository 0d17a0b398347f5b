from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import quantiles

POST = "channel_id bigint, msg_id bigint, views bigint, source string"


@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=3000), st.integers(1, 6), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_bounds_hold_for_any_split_and_merge_order(values, parts, seed):
    rng = np.random.default_rng(seed)
    whole = quantiles.Sketch(32)
    for chunk in np.array_split(np.array(values, dtype=float), parts):
        part = quantiles.Sketch(32)
        for piece in np.array_split(chunk, int(rng.integers(1, 5))):
            part.add(piece)
        whole.merge(*part.row(0)[2:])
    assert whole.n == len(values)
    ordered = np.sort(values)
    ranks = sorted({1, len(values) // 4 + 1, (len(values) + 1) // 2, len(values)})
    for r, (value, low, high) in zip(ranks, whole.at(ranks)):
        assert low <= ordered[r - 1] <= high
        assert low <= value <= high
    assert max(whole.over, whole.under) <= len(values) * max(1, np.log2(max(2, len(values) / 32))) / 32 + 1


def test_small_groups_are_exact_and_repeats_count_once(spark):
    data = [(1, m, m * 10, "x") for m in range(9)] * 2 + [(2, 1, None, "y"), (None, 1, 5, "z"), (3, 1, 7, None)]
    got = {r["source"]: r for r in quantiles.percentiles(spark.createDataFrame(data, POST)).collect()}
    assert set(got) == {1, 3}
    assert got[1]["p50"] == 40 and got[1]["n"] == 9 and got[1]["rank_error"] == 0
    assert got[1]["p25"] == 20 and got[3]["p90"] == 7


def test_large_group_spans_partitions_within_bounds(spark):
    rng = np.random.default_rng(3)
    values = rng.lognormal(8, 2, 6000).astype(int)
    df = spark.createDataFrame([(1, i, int(v), "") for i, v in enumerate(values)], POST)
    r = quantiles.percentiles(df, size=64).first()
    for share in (10, 25, 50, 75, 90):
        assert r[f"p{share}_low"] <= np.percentile(values, share) <= r[f"p{share}_high"]
    assert r["rank_error"] < 0.1 * len(values)


def test_days_combine_to_the_whole(spark):
    df = spark.createDataFrame([(1, i, (i * 37) % 501, "") for i in range(2000)], POST)
    days = [quantiles.sketch_values(df.where(f"msg_id % 3 = {d}"), "channel_id", "msg_id", "views", 64) for d in range(3)]
    merged = quantiles.merge_sketches(days[0].unionByName(days[1]).unionByName(days[2]), quantiles.AsPercentiles((0.5,)), 64).first()
    assert merged["n"] == 2000 and merged["p50_low"] <= 250 <= merged["p50_high"]


def test_wrong_medians(spark, rows):
    posts = [(c, m, 100 + m % 3, "") for c in (1, 2, 3, 4, 6) for m in range(700)] + [(5, 1, None, "")]
    card = [(1, 101.0), (2, None), (3, 122.0), (4, 80.5), (5, None), (6, float("nan")), (7, 1.0), (1, 101.0), (4, 84.0)]
    found = quantiles.wrong_medians(spark.createDataFrame(posts, POST), spark.createDataFrame(card, "tg_id bigint, median_views double"), size=32)
    assert rows(found) == [(2,), (3,), (4,), (6,)]


def test_empty(spark, rows):
    assert rows(quantiles.percentiles(spark.createDataFrame([], POST))) == []


def test_hot_source_merges_in_a_tree(spark, monkeypatch):
    """A source over many partitions: rounds of two branches give bounds that hold, and one row."""
    monkeypatch.setattr(quantiles, "FAN", 2)
    values = [(i * 7919) % 10_007 for i in range(5000)]
    df = spark.createDataFrame([(1, i, v, "") for i, v in enumerate(values)] + [(2, 1, 5, "")], POST)
    got = {r["source"]: r for r in quantiles.percentiles(df, size=32).collect()}
    assert got[1]["n"] == 5000 and got[1]["p50_low"] <= np.median(values) <= got[1]["p50_high"]
    assert got[1]["rank_error"] <= 5000 * np.log2(5000 / 32) / (4 * 32) + 2 ** 8 and got[2]["p50"] == 5


def test_buffer_size_follows_the_error():
    assert quantiles.buffer_size(0.01) < quantiles.buffer_size(0.001)
    for error in (0.05, 0.01, 0.002):
        size, n = quantiles.buffer_size(error, 1 << 30), 1 << 30
        assert np.log2(n / size) / (4 * size) <= error
