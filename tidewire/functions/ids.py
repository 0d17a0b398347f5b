"""Channel ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prefixed id is minus (this number plus the bare id).
PREFIX = 1_000_000_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bare_id(c: Column | str) -> Column:
    """The bare form of a channel id; the prefixed form (-100 and ten digits) names the same channel."""
    c = col(c)
    return F.when(c < -PREFIX, -c - F.lit(PREFIX)).otherwise(c)


def ordered_pair(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """An unordered pair as (smaller, larger)."""
    return F.least(col(a), col(b)), F.greatest(col(a), col(b))
