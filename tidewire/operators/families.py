"""Families: channels joined by confirmed pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.ids import bare_id, ordered_pair
from tidewire.session import materialise


def current_pairs(candidates: DataFrame) -> DataFrame:
    """The standing decision of each unordered pair of two different channels: that of its row with the highest run.

    Ids are brought into bare form, decisions are read without case and surrounding spaces. A null run is the lowest;
    rows of one run that disagree give the decision last in the alphabet (rejected before pending before confirmed).
    Pairs with a null end are left out.
    """
    low, high = ordered_pair(bare_id("channel_a"), bare_id("channel_b"))
    rows = candidates.select(bare_id("channel_a").alias("x"), bare_id("channel_b").alias("y"), low.alias("a"), high.alias("b"), "run_id", F.lower(F.trim("decision")).alias("decision"))
    last = rows.where("x is not null and y is not null and x <> y").groupBy("a", "b").agg(F.max(F.struct("run_id", "decision")).alias("last"))
    return last.select("a", "b", F.col("last.run_id").alias("run_id"), F.col("last.decision").alias("decision"))


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vertices of the edges and the least vertex of each one's component among them."""
    vertices, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    parent = np.arange(len(vertices))
    while True:
        px, py = parent[x], parent[y]
        differ = px != py
        if not differ.any():
            return vertices, vertices[parent]
        x, y, low, high = x[differ], y[differ], np.minimum(px, py)[differ], np.maximum(px, py)[differ]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


#: Pairs that a task contracts at a time: some tens of MB in a Python worker.
PIECE = 500_000


def local_stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of a partition, contracted piece by piece to stars around the least vertex: what a combiner does for sums."""
    held, size = [], 0

    def stars() -> pd.DataFrame:
        rows = pd.concat(held)
        vertices, least = union_find(rows["a"].to_numpy(), rows["b"].to_numpy())
        return pd.DataFrame({"a": vertices, "b": least})[vertices != least]

    for pdf in frames:
        held.append(pdf)
        size += len(pdf)
        if size >= PIECE:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def closure(pairs: DataFrame) -> DataFrame:
    """vertex, component (the least vertex reached) of linked pairs (a, b), by large and small stars in turn.

    A large star links a vertex's greater neighbours to the least of its neighbourhood, a small star its lesser ones; both
    keep components and shorten paths, until every component is one star around its least vertex. Each step is a combined
    minimum and a join. Partitions are contracted by themselves first, so the steps join them rather than find each path.
    Repeated pairs count once, loops and nulls link nothing, no pairs give no rows.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = lambda rows: rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tidy = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)")).alias("h")).first()
    plain = pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = materialise(tidy(plain.mapInPandas(local_stars, "a bigint, b bigint")))
    before, now = None, state(edges)
    while now != before:
        near = both(edges)
        large = tidy(near.join(least(near), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = down.join(least(down), "u")
        linked = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = materialise(tidy(linked))
        before, now = now, state(edges)
    stars = edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("component"))).distinct()


def families(candidates: DataFrame) -> DataFrame:
    """channel_id and family_key (the least id) of every channel in a family of two or more."""
    confirmed = current_pairs(candidates).where("decision = 'confirmed'")
    return closure(confirmed).select(F.col("vertex").alias("channel_id"), F.col("component").alias("family_key"))


def family_changes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """What replaces a stored grouping: channel_id, old_key, new_key, change (added, removed, moved)."""
    old = stored.select(bare_id("channel_id").alias("channel_id"), bare_id("family_key").alias("old_key")).where("channel_id is not null").distinct()
    both = old.join(fresh.withColumnRenamed("family_key", "new_key"), "channel_id", "full")
    change = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").otherwise("moved")
    return both.where("not (old_key <=> new_key)").select("channel_id", "old_key", "new_key", change.alias("change"))
