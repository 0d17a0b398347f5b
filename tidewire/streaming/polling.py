"""Per-channel polling state kept by the stream: empty and failed polls in a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "tg_id bigint, polls bigint, consecutive_empty int, consecutive_failures int, last_error string"
STATE = "polls bigint, consecutive_empty int, consecutive_failures int, last_error string"


def since_last(stop: np.ndarray, counts: np.ndarray, before: int) -> int:
    """How many of ``counts`` come after the last ``stop``; with no stop, those and the number before."""
    at = np.flatnonzero(stop)
    return int(counts[at[-1] + 1 :].sum()) if len(at) else before + int(counts.sum())


def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Apply polls in the order of their moments; a success resets failures, new posts reset empty polls."""
    polls, empty, failures, error = state.get if state.exists else (0, 0, 0, None)
    rows = pd.concat(list(frames)).sort_values(["polled_at", "new_posts"], kind="stable")
    failed = rows["error"].notna().to_numpy()
    found = ~failed & (rows["new_posts"].fillna(0) > 0).to_numpy()
    empty = since_last(found, ~failed & ~found, empty)
    failures = since_last(~failed, failed, failures)
    error = rows["error"].iloc[-1][:500] if len(rows) and failed[-1] else None
    state.update((int(polls) + len(rows), empty, failures, error))
    yield pd.DataFrame({"tg_id": [key[0]], "polls": [int(polls) + len(rows)], "consecutive_empty": [empty], "consecutive_failures": [failures], "last_error": [error]})


def poll_state(polls: DataFrame) -> DataFrame:
    """A stream of the newest state of each polled channel. polls: tg_id, polled_at, new_posts, error.

    State is four values a channel and stays, as counters of a channel must; a processing-time timeout would also keep an
    idle stream busy with empty batches.
    """
    return polls.groupBy("tg_id").applyInPandasWithState(advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
