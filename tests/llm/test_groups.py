from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewire.llm.components import components, pair_groups, union_find


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


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_union_find_matches_plain(edges):
    a, b = np.array(edges).T
    vertices, least = union_find(a, b)
    loops = sorted((int(v), int(v)) for v in set(a) | set(b))
    expected = dict(loops) | dict(plain(edges))
    assert dict(zip(vertices.tolist(), least.tolist())) == expected


@pytest.mark.parametrize(("edges", "cell_edges"), [
    ([(i, i + 1) for i in range(300)], 40),
    ([(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(500, 700)], 60),
    ([(5, 5), (None, 3), (3, None), (4, 3), (3, 4), (4, 3)], 250_000),
])
def test_grid_rounds_give_least_vertex(spark, rows, edges, cell_edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert rows(components(df, cell_edges=cell_edges)) == plain(edges)


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_grid_on_random_graphs(spark, rows, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 150, 140), rng.integers(0, 150, 140))]
    assert rows(components(spark.createDataFrame(edges, "a bigint, b bigint"), cell_edges=30)) == plain(edges)


def test_no_edges(spark, rows):
    assert rows(components(spark.createDataFrame([], "a bigint, b bigint"))) == []


CANDIDATE = "channel_a bigint, channel_b bigint, decision string, run_id bigint, vertex string"


def test_latest_decision_of_a_pair_counts(spark, rows):
    data = [
        (1100000001, 1100000002, " Confirmed ", 1, "x"),
        (1100000002, -1001100000001, "rejected", 2, "x"),  # the same pair, later, prefixed id
        (1100000003, 1100000004, "CONFIRMED", 5, "x"),
        (1100000004, 1100000003, "pending", 4, "x"),
        (1100000004, 1100000005, "confirmed", 1, None),
        (1100000006, 1100000006, "confirmed", 1, None),
        (1100000006, -1001100000006, "confirmed", 1, None),
        (None, 1100000006, "confirmed", 1, None),
        (1100000007, 1100000008, None, 1, None),
        (1100000009, 1100000010, "confirmed", None, None),
    ]
    found = pair_groups(spark.createDataFrame(data, CANDIDATE))
    assert rows(found) == [(1100000003, 1100000003), (1100000004, 1100000003), (1100000005, 1100000003), (1100000009, 1100000009), (1100000010, 1100000009)]


def test_hub_over_cells_and_pieces(spark, rows):
    """A hub with a third of all edges and a chain: cells in pieces, and lookups of a hot parent."""
    edges = [(7, i) for i in range(1000, 1400)] + [(i, i + 1) for i in range(2000, 2300)] + [(i, i + 1) for i in range(5000, 5400, 2)]
    assert rows(components(spark.createDataFrame(edges, "a bigint, b bigint"), cell_edges=25)) == plain(edges)


def test_lookup_of_hot_keys(spark, rows, monkeypatch):
    from tidewire.llm import components as module

    monkeypatch.setattr(module, "CELL_EDGES", 10)
    left = spark.createDataFrame([(i, 1 if i < 60 else i) for i in range(100)], "vertex bigint, parent bigint")
    table = spark.createDataFrame([(1, 0), (70, 5), (99, 98)], "parent bigint, top bigint")
    got = rows(module.lookup(left, "parent", table, 100), "vertex", "top")
    assert got == sorted([(i, 0 if i < 60 else {70: 5, 99: 98}.get(i)) for i in range(100)], key=lambda r: r[0])
