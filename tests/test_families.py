from __future__ import annotations

import numpy as np
import pytest

from tidewire.operators import families


def plain(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return sorted((v, find(v)) for v in parent)


RANDOM = [(int(a), int(b)) for a, b in zip(*np.random.default_rng(5).integers(0, 200, (2, 150)))]


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)], [(60 - i, 61 - i) for i in range(60)], [(0, i) for i in range(1, 80)] + [(90, i) for i in range(100, 140)] + [(90, 139)],
    RANDOM, [(5, 5), (None, 3), (3, None), (4, 3), (3, 4), (4, 3)], [],
])
def test_stars_end_at_the_least_vertex(spark, rows, edges):
    assert rows(families.closure(spark.createDataFrame(edges, "a bigint, b bigint"))) == plain(edges)


CANDIDATE = "channel_a bigint, channel_b bigint, decision string, run_id bigint, vertex string"


def test_latest_decision_of_a_pair_counts(spark, rows):
    data = [
        (1100000001, 1100000002, " Confirmed ", 1, "x"),
        (1100000002, -1001100000001, "rejected", 2, "x"),  # the same pair, later, prefixed id
        (1100000003, 1100000004, "CONFIRMED", 5, "x"),
        (1100000004, 1100000003, "pending", 4, "x"),
        (1100000004, 1100000005, "confirmed", 1, None),
        (1100000006, -1001100000006, "confirmed", 1, None),
        (None, 1100000006, "confirmed", 1, None),
        (1100000007, 1100000008, None, 1, None),
        (1100000009, 1100000010, "confirmed", None, None),
    ]
    found = families.families(spark.createDataFrame(data, CANDIDATE))
    assert rows(found) == [(1100000003, 1100000003), (1100000004, 1100000003), (1100000005, 1100000003), (1100000009, 1100000009), (1100000010, 1100000009)]


def test_changes_against_a_stored_grouping(spark, rows):
    stored = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 3)], "channel_id bigint, family_key bigint")
    fresh = spark.createDataFrame([(1, 1), (2, 2), (4, 4)], "channel_id bigint, family_key bigint")
    assert rows(families.family_changes(stored, fresh)) == [(2, 1, 2, "moved"), (3, 3, None, "removed"), (4, None, 4, "added")]
