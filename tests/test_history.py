from __future__ import annotations

import json
import math
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewire.operators import history

UNIT = "entity bigint, attr string, at bigint, value string"


def plain(units):
    out = []
    for key in sorted({(e, a) for e, a, *_ in units}):
        own = sorted((t, v is not None, v or "") for e, a, t, v in units if (e, a) == key)
        versions = []
        for t, known, v in own:
            v = v if known else None
            if not versions or versions[-1][0] != v:
                versions.append([v, t, t, 0])
            versions[-1][2:] = t, versions[-1][3] + 1
        ends = [v[1] for v in versions[1:]] + [None]
        out += [(*key, v, t, end, seen, n) for (v, t, seen, n), end in zip(versions, ends)]
    return sorted(out, key=lambda row: tuple((v is None, v) for v in row))


def unit_runs(values):
    n = len(values)
    return pd.DataFrame({"attr": ["a"] * n, "entity": np.ones(n, dtype="int64"), "value": np.array(values, dtype=object), "since": np.arange(n), "seen": np.arange(n), "units": np.ones(n, dtype="int64")})


def run_list(runs):
    return list(runs[["value", "since", "seen", "units"]].itertuples(index=False, name=None))


@given(st.lists(st.sampled_from(["x", "y", None]), min_size=1, max_size=200), st.lists(st.integers(1, 199), max_size=6))
def test_reduction_is_right_logarithmic_and_associative(values, cuts):
    runs, _, rounds = history.reduce_runs(unit_runs(values))
    expected = []
    for t, v in enumerate(values):
        if expected and expected[-1][0] == v:
            expected[-1] = (v, expected[-1][1], t, expected[-1][3] + 1)
        else:
            expected.append((v, t, t, 1))
    assert run_list(runs) == expected
    assert rounds == max(0, math.ceil(math.log2(len(values))))
    # the same in other brackets: the runs of parts, reduced again
    bounds = [0, *sorted({c for c in cuts if c < len(values)}), len(values)]
    parts = [history.reduce_runs(unit_runs(values).iloc[a:b].reset_index(drop=True))[0] for a, b in zip(bounds[:-1], bounds[1:])]
    assert run_list(history.reduce_runs(pd.concat(parts, ignore_index=True))[0]) == expected


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_versions_over_partitions(spark, rows, seed):
    rng = np.random.default_rng(seed)
    units = []
    for e in range(5):
        for t in range(400 if e == 0 else 30):
            units.append((e, str(rng.choice(["a", "b"])), t * 10, [None, "x", "y"][int(rng.random() * 3) if rng.random() < 0.1 else 1]))
    units += units[:50]
    assert rows(history.versions(spark.createDataFrame(units, UNIT))) == plain(units)


def test_one_value_over_all_partitions(spark, rows):
    units = [(1, "a", t, "same") for t in range(500)]
    assert rows(history.versions(spark.createDataFrame(units, UNIT))) == [(1, "a", "same", 0, None, 499, 500)]


def payload(i, **values):
    return json.dumps({"full_chat": {"id": i, "about": values.get("about")}, "chats": [{"id": i, **{k: v for k, v in values.items() if k != "about"}}]}, ensure_ascii=False)


def test_channel_spellings_and_failed_fetches(spark, rows):
    at = lambda s: datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None)
    good = payload(1, username="@Name ", title="Café  one", about=" ")
    data = [
        (1, good, at(100)), (1, good, at(100)),
        (1, payload(1, username="name", title="Café one"), at(200)),
        (1, None, at(300)), (1, good[:40], at(310)), (1, '{"_": "RpcError"}', at(320)), (1, payload(2, title="other"), at(330)), (1, "", at(340)),
        (1, payload(1, username="name", title="Café two", about="x" * 5000), at(400)),
        (1, payload(1, username=None, title="Café one", about="x" * 5000), at(500)),
        (None, good, at(1)),
    ]
    df = spark.createDataFrame([(*r, "z") for r in data], "channel_id bigint, payload string, fetched_at timestamp_ntz, entity string")
    found = rows(history.channel_history(df), "attr", "valid_from_s", "valid_to_s")
    assert found == [
        ("about", 100, 400), ("about", 400, None), ("title", 100, 400), ("title", 400, 500), ("title", 500, None), ("username", 100, 500), ("username", 500, None),
    ]


def test_empty(spark, rows):
    assert rows(history.channel_history(spark.createDataFrame([], "channel_id bigint, payload string, fetched_at timestamp"))) == []
