from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import baselines, communities, medians, rankings

T0 = datetime(2026, 8, 6, 12)
OBS = "channel_id bigint, msg_id bigint, observed_at timestamp, published_at timestamp, album bigint, views bigint, forwards bigint, reactions bigint, comments bigint"


CHANNEL = "tg_id bigint, kind string, status string, is_chat boolean"


def test_exact_medians_of_doubles(spark):
    rng = np.random.default_rng(6)
    data = [(g, float(v)) for g in range(4) for v in np.round(rng.normal(0, 1, 301 + g), 3)] + [(5, 0.0), (5, 0.0), (6, -1e-300), (6, 1e300), (7, None)]
    got = {r["g"]: (r["n"], r["median"]) for r in medians.exact_medians(spark.createDataFrame(data, "g int, v double"), ["g"], "v").collect()}
    assert got == {g: (len(x), float(np.median(x))) for g in [0, 1, 2, 3, 5, 6] for x in [[v for h, v in data if h == g]]}


def test_scope_albums_and_moments_of_scoring(spark, rows):
    """Only seeds that are no chats are scored, an album by its first part in the window, nothing later than now is seen."""
    p = baselines.BaselineParams()
    known = spark.createDataFrame([(1, "a", "seed", False), (2, "a", "seed", True), (3, "a", "maybe", False), (4, "a", "seed", False)], CHANNEL)
    scoped = baselines.scope(known, spark.createDataFrame([(4, "permanent"), (1, "transient"), (4, None)], "tg_id bigint, failure_kind string"))
    assert rows(scoped, "channel_id", "seed", "healthy") == [(1, True, True), (2, False, True), (3, False, True), (4, True, False)]
    at = lambda m: T0 + timedelta(minutes=m)
    obs = [(1, 10, at(30), T0, 7, 5, 1, 1, 1), (1, 11, at(30), T0, 7, 9, 1, 1, 1), (1, 12, at(30), T0, None, 5, 1, 1, 1), (1, 12, at(90), T0, None, 8, 1, 1, 1), (2, 1, at(30), T0, None, 5, 1, 1, 1), (3, 1, at(30), T0, None, 5, 1, 1, 1),
           (4, 1, at(30), T0, None, 5, 1, 1, 1), (1, 8, at(30), T0 - timedelta(days=9), 7, 5, 1, 1, 1)]
    long = baselines.readings(spark.createDataFrame(obs, OBS), scoped, p)
    seen = baselines.scored_readings(long, F.lit(T0 - timedelta(days=1)), F.lit(at(60))).where("metric = 'views'")
    assert rows(seen, "channel_id", "msg_id", "value") == [(1, 10, 5.0), (1, 12, 5.0), (4, 1, 5.0)]


def test_a_stored_baseline_is_loaded_by_its_newest_completed_run(spark, rows):
    p = baselines.BaselineParams()
    kinds = baselines.scope(spark.createDataFrame([(1, "a", "seed", False), (2, "b", "seed", False)], CHANNEL))
    long = baselines.readings(spark.createDataFrame(snapshots(), OBS), kinds, p)
    m, fit = baselines.mature_medians(long, p), baselines.fit(long, p)
    old, new = baselines.stored(m.limit(1), fit.limit(1), 1, F.lit(T0)), baselines.stored(m, fit, 2, F.lit(T0 + timedelta(days=1)))
    kept = baselines.StoredBaseline(*[a.unionByName(b) for a, b in zip((old.runs, old.medians, old.curves), (new.runs, new.medians, new.curves))])
    got_m, got_fit = baselines.load(kept)
    assert rows(got_m.select(m.columns)) == rows(m) and got_fit.count() == fit.count()
    assert baselines.load(kept, F.lit(T0))[0].count() == 1


def test_group_medians_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = [(int(g), None if rng.random() < 0.1 else int(v)) for g in range(5) for v in rng.lognormal(6, 3, 200 + g) * rng.choice([1, -1], 200 + g, p=[0.9, 0.1])]
    df = spark.createDataFrame([*data, (9, None)], "g bigint, v bigint")
    got = {r["g"]: r["median"] for r in medians.group_medians(df, ["g"], ["v"]).collect()}
    assert got == {g: float(np.median([v for h, v in data if h == g and v is not None])) for g in range(5)}


def snapshots(fraction=None):
    fraction = fraction or {15: 0.2, 120: 0.5, 480: 1.0}
    out = []
    for c, level in ((1, 100), (2, 100_000)):
        for m in range(30):
            size = level * (0.8 + 0.02 * m)
            for age, f in fraction.items():
                out.append((c, m, T0 + timedelta(minutes=age), T0, None, int(size * f), None, None, None))
            out.append((c, m, T0 + timedelta(days=40), T0, None, int(size * 2), None, None, None))
        out.append((c, 99, T0 - timedelta(minutes=5), T0, None, 10**9, None, None, None))  # before publication
    return out


def test_baseline_drops_channel_size_and_scores_age(spark):
    p = baselines.BaselineParams()
    kinds = baselines.scope(spark.createDataFrame([(1, "a", "seed", False), (2, "b", "seed", False), (3, None, "seed", False)], CHANNEL))
    long = baselines.readings(spark.createDataFrame(snapshots(), OBS), kinds, p)
    fit = baselines.fit(long, p)
    got = {(r["kind"], r["metric"], r["band"]): r for r in fit.collect()}
    assert set(k[1] for k in got) == {"views"} and {k[2] for k in got} == {"15m", "105m", "420m"}
    assert got["a", "views", "420m"]["fraction"] == 1 and abs(got["a", "views", "105m"]["fraction"] - 0.5) < 0.02
    assert abs(got["a", "views", "15m"]["factor"] - 0.5) < 0.02 and not got["a", "views", "15m"]["borrowed"]
    medians_ = baselines.mature_medians(long, p)
    spike = (2, 500, T0 + timedelta(minutes=120), T0, None, 900_000, None, None, None)
    quiet = (2, 501, T0 + timedelta(minutes=120), T0, None, 0, None, None, None)
    new = baselines.readings(spark.createDataFrame([spike, quiet], OBS), kinds, p)
    scored = {r["msg_id"]: r["z"] for r in baselines.scores(new, fit, medians_, p).collect()}
    assert scored[500] > 3.3 and scored[501] < -3.3
    assert [r["msg_id"] for r in baselines.spikes(baselines.scores(new, fit, medians_, p), p).collect()] == [500]
    assert baselines.scores(new, fit, medians_, p, now=F.lit(T0 + timedelta(minutes=100))).count() == 0


def test_thin_kind_borrows_the_whole_fit(spark):
    p = baselines.BaselineParams()
    kinds = baselines.scope(spark.createDataFrame([(1, "a", "seed", False), (2, "a", "seed", False), (3, "thin", "seed", False)], CHANNEL))
    few = [(3, m, T0 + timedelta(minutes=15), T0, None, 5, None, None, None) for m in range(3)]
    got = baselines.fit(baselines.readings(spark.createDataFrame([*snapshots(), *few], OBS), kinds, p), p)
    a, thin = ({(r["band"], r["fraction"], r["factor"], r["spread"]) for r in got.where(f"kind = '{k}'").collect()} for k in ("a", "thin"))
    assert thin and {r["borrowed"] for r in got.where("kind = 'thin'").collect()} == {True}
    assert {b for b, *_ in thin} == {b for b, *_ in a}
    with pytest.raises(ValueError):
        baselines.BaselineParams(mature_days=5, mature_max_days=5)


def test_variety_and_reciprocity(spark):
    edges = spark.createDataFrame([(1, 2, 1, 2, "f"), (1, 3, 1, 3, "f"), (2, 1, 2, 1, "f"), (1, 2, 1, 2, "m"), (1, 3, 1, 3, "m")], "src bigint, dst bigint, src_family bigint, dst_family bigint, kind string")
    got = {r["channel_id"]: tuple(r)[1:] for r in rankings.variety(edges, spark.createDataFrame([(2,), (1,)], "channel_id bigint")).collect()}
    assert got[1] == (1.0, 2, 1, 1.0) and got[2] == (0.0, 1, 1, 1.0) and got[3] == (None, 0, 1, None)


def test_albums_take_longest_text_and_greatest_counters(spark):
    kind = "channel_id bigint, msg_id bigint, grouped_id bigint, published timestamp, views bigint, forwards bigint, reactions bigint, comments bigint, text string"
    df = spark.createDataFrame([(1, 5, 7, T0, 10, 1, None, None, "aa"), (1, 6, 7, T0, 9, 4, None, 2, "bb"), (1, 7, None, T0, 1, 1, 1, 1, None), (2, 5, 7, T0, 3, 3, 3, 3, "")], kind)
    got = {(r["channel_id"], r["msg_id"]): (r["parts"], r["views"], r["forwards"], r["comments"], r["text"]) for r in rankings.collapse_albums(df).collect()}
    assert got == {(1, 5): (2, 10, 4, 2, "bb"), (1, 7): (1, 1, 1, 1, None), (2, 5): (1, 3, 3, 3, "")}


def test_share_below_is_strict(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, None), (5, 1)], "id int, v int")
    assert rows(rankings.share_below(df, "v"), "id", "v_below") == [(1, 0.25), (2, 0.25), (3, 0.75), (4, None), (5, 0.0)]


def modularity(pairs, label):
    total = sum(w for *_, w in pairs)
    inside = sum(w for a, b, w in pairs if label[a] == label[b]) / total
    mass = {}
    for a, b, w in pairs:
        mass[label[a]] = mass.get(label[a], 0) + w
        mass[label[b]] = mass.get(label[b], 0) + w
    return inside - sum((m / (2 * total)) ** 2 for m in mass.values())


def test_propagation_settles(spark):
    """Labels end where no node would move: long paths, pairs that could swap for ever, separate groups."""
    groups = [(a, b, 1.0) for g in range(3) for a in range(g * 10, g * 10 + 10) for b in range(a + 1, g * 10 + 10)]
    path = [(i, i + 1, 1.0) for i in range(100, 160)] + [(200, 201, 1.0)]
    got = {r["node"]: r["community"] for r in communities.propagate(spark.createDataFrame(groups + path, "a bigint, b bigint, weight double")).collect()}
    assert [len({got[n] for n in range(g * 10, g * 10 + 10)}) for g in range(3)] == [1, 1, 1] and got[0] != got[10]
    for node in range(101, 160):
        assert got[node] in (got[node - 1], got[node + 1])
    assert got[200] == got[201]


def test_communities_hold_together(spark, rows):
    labels = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (5, 1, 0.5), (6, 1, 0.5), (7, 7, 1.0)], "node bigint, community bigint, stability double")
    pairs = spark.createDataFrame([(1, 2, 1.0), (5, 6, 1.0), (6, 7, 1.0)], "a bigint, b bigint, weight double")
    assert rows(communities.connected(labels, pairs), "node", "community") == [(1, 1), (2, 1), (5, 5), (6, 5), (7, 7)]


def test_stability_counts_all_mates(spark, rows):
    from collections import defaultdict

    runs = {0: [1, 1, 1, 1, 5, 6, 6], 1: [1, 1, 3, 3, 5, 6, 7], 2: [1, 2, 1, 1, 1, 6, 6]}
    df = spark.createDataFrame([(s, n, c) for s, labels in runs.items() for n, c in enumerate(labels, 1)], "seed int, node bigint, community bigint")
    got = {r["node"]: r["stability"] for r in communities.with_stability(df, 0).collect()}
    mates = defaultdict(list)
    for n in range(1, 8):
        mates[n] = [m for m in range(1, 8) if m != n and runs[0][m - 1] == runs[0][n - 1]]
    want = {n: sum(labels[n - 1] == labels[m - 1] for labels in runs.values() for m in ms) / (3 * len(ms)) if ms else 1.0 for n, ms in mates.items()}
    assert got == pytest.approx(want)
    assert len(communities.CommunityParams().seeds) == 50


def test_partition_is_one_method_at_every_size(spark):
    rng = np.random.default_rng(2)
    pairs = [(a, b, 1.0) for g in range(3) for a in range(g * 12, g * 12 + 12) for b in range(a + 1, g * 12 + 12) if rng.random() < 0.6] + [(0, 12, 1.0), (12, 24, 1.0)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint, weight double")
    got = communities.partition(df, communities.CommunityParams(resolution=1.0, seeds=(1, 2), local_edges=10)).collect()
    label = {r["node"]: r["community"] for r in got}
    assert set(label) == {x for a, b, _ in pairs for x in (a, b)} and all(0 <= r["stability"] <= 1 for r in got)
    assert len(set(label.values())) == 3 and modularity(pairs, label) > 0.6
    assert all(c == min(n for n in label if label[n] == c) for c in label.values())
    local = communities.partition(df, communities.CommunityParams(resolution=1.0, seeds=(1, 2))).collect()
    assert sorted(map(tuple, local)) == sorted(map(tuple, got))  # the size decides only where the rounds are made
    # at a high resolution every node stays alone: the resolution counts at every size, and lone nodes score 1
    fine = communities.partition(df, communities.CommunityParams(resolution=500.0, seeds=(1, 2), local_edges=10)).collect()
    assert len({r["community"] for r in fine}) == len(label) and {r["stability"] for r in fine} == {1.0}
    assert communities.partition(df.limit(0), communities.CommunityParams(seeds=(1,))).count() == 0


def test_nmi_ends(spark):
    left = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "node bigint, community bigint")
    right = spark.createDataFrame([(1, 8), (2, 8), (3, 9), (4, 9)], "node bigint, community bigint")
    across = spark.createDataFrame([(1, 8), (2, 9), (3, 8), (4, 9)], "node bigint, community bigint")
    assert abs(communities.nmi(left, right).first()["nmi"] - 1) < 1e-9
    assert abs(communities.nmi(left, across).first()["nmi"]) < 1e-9
