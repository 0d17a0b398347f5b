from __future__ import annotations

import numpy as np
import pytest

from tidewire.operators import spikes

SCHEMA = "channel_id bigint, msg_id bigint, views bigint, forwards bigint, reactions bigint"


def brute(rows):
    """The rules as they are written, post by post."""
    found = set()
    posts = {}
    for c, m, *values in rows:
        if c is not None and m is not None:
            old = posts.get((c, m), [None] * 3)
            posts[c, m] = [max((x for x in pair if x is not None), default=None) for pair in zip(old, values)]
    for c in {k[0] for k in posts}:
        own = sorted((m, v) for (ch, m), v in posts.items() if ch == c)
        for j in range(3):
            known = [v[j] for _, v in own if v[j] is not None]
            middle = float(np.median(known)) if known else None
            i = 0
            while i < len(own):
                k = i
                while k + 1 < len(own) and own[k + 1][1][j] == own[i][1][j] and own[i][1][j] is not None:
                    k += 1
                for m, v in own[i : k + 1]:
                    x = v[j]
                    if x is None:
                        continue
                    if x < 0 or (x >= 50 and (x >= 10 * middle or k - i + 1 > 3)) or (j and v[0] is not None and x > v[0]):
                        found.add((c, m))
                i = k + 1
    return sorted(found)


def sample(seed: int, channels: int = 6, posts: int = 90):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(channels):
        level = 10 ** rng.uniform(1, 5)
        n = posts * (8 if c == 0 else 1)
        for m in range(n):
            views = int(level * rng.lognormal(0, 0.3))
            row = [c, m, views, int(views * 0.02), int(views * 0.05)]
            for j in (2, 3, 4):
                u = rng.random()
                if u < 0.03:
                    row[j] = None
                elif u < 0.05:
                    row[j] = int(max(row[j], 5) * rng.choice([10, 40, 1000]))
                elif u < 0.06:
                    row[j] = -row[j]
            rows.append(tuple(row))
        for start in range(5, n - 9, 40):
            length = int(rng.integers(2, 7))
            for k in range(length):
                rows[len(rows) - n + start + k] = (c, start + k, 777, 60, 60)
    rows += [rows[i] for i in rng.integers(0, len(rows), 40)]
    rng.shuffle(rows)
    return [tuple(None if x is None else int(x) for x in r) for r in rows]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_finds_what_the_rules_say_across_partitions(spark, rows, seed):
    data = sample(seed)
    found = spikes.implausible_posts(spark.createDataFrame(data, SCHEMA))
    assert rows(found) == brute(data)


def test_run_over_many_partitions_counts_whole(spark, rows):
    data = [(1, m, 5000 + m % 7, None, None) for m in range(40)] + [(1, 40 + m, 5003, None, None) for m in range(30)]
    assert rows(spikes.implausible_posts(spark.createDataFrame(data, SCHEMA))) == brute(data)


@pytest.mark.parametrize("run", [3, 4, 5])
def test_runs_near_the_median_of_a_narrow_channel(spark, rows, run):
    data = [(1, m, 5000 + 37 * (m % 11) - 185, None, None) for m in range(60)] + [(1, 60 + m, 5000, None, None) for m in range(run)] + [(1, 70 + m, 5001 + 41 * m, None, None) for m in range(9)]
    assert rows(spikes.implausible_posts(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_empty_null_ties_and_clashing_columns(spark, rows):
    assert rows(spikes.implausible_posts(spark.createDataFrame([], SCHEMA))) == []
    odd = [(None, 1, 5, 6, 7), (1, None, -5, 1, 1), (1, 1, None, None, None), (2, 1, -1, None, None), (2, 1, -1, None, None), (3, 1, 10, 11, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in odd], SCHEMA + ", source string, position int")
    assert rows(spikes.implausible_posts(df)) == [(2, 1), (3, 1)]


def test_forward_backward_equals_plain_recursion():
    rng = np.random.default_rng(0)
    params = spikes.SpikeParams()
    like = rng.random((150, 3, 4)) + 0.01
    resets = rng.random(150) < 0.1
    resets[0] = True
    a = spikes.step_matrices(like, resets, params)
    p = spikes.posterior(a, np.tile(params.start, (3, 1)), np.ones((3, 4)))
    forward, backward = np.zeros((150, 3, 4)), np.ones((150, 3, 4))
    state = np.tile(params.start, (3, 1))
    for t in range(150):
        state = np.einsum("ms,mst->mt", state, a[t])
        state /= state.sum(axis=1, keepdims=True)
        forward[t] = state
    state = np.ones((3, 4))
    for t in range(149, 0, -1):
        state = np.einsum("mst,mt->ms", a[t], state)
        state /= state.sum(axis=1, keepdims=True)
        backward[t - 1] = state
    both = forward * backward
    assert np.allclose(p, both / both.sum(axis=2, keepdims=True))
