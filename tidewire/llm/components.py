"""Groups of directly or indirectly linked records: connected components on a two-dimensional grid.

Vertices are hashed into blocks and an edge belongs to the cell (block of its lower end, block of its
upper end), so even a vertex with a third of all edges is spread over a whole row or column of cells.
Each cell runs a local union-find; a vertex then takes the least representative that the cells of its
row and column found. These parents form trees of falling ids, which pointer jumping flattens; what else a
vertex saw links the trees' roots and makes the edges of the next round. As a root has a neighbour that is
none, each round at least halves the vertices, however deep the components are. When no edge is left the
parents have stabilised and are composed downwards.

A cell is read as a stream in pieces of bounded size, each with a union-find of its own, so the cells of a hub,
which hold more edges than others, cost time and no memory. The root of a giant component is the parent of many
rows; such parents are looked up by broadcast, of which there are a few per task at most, the rest by shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.families import current_pairs, union_find
from tidewire.session import materialise

#: Edges that one cell is meant to hold and that a piece of a cell holds at most: some tens of MB in a Python worker.
CELL_EDGES = 250_000
FIRST_GRID = 4
#: A parent is looked up by broadcast where it holds more than 1 / HOT of a task's even share of rows.
HOT = 4


def cells(limit: int):
    """Local union-find of the cells of a partition, which come one after the other; no piece exceeds ``limit`` by more than a batch."""

    def solve(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        vertices, least = union_find(*(np.concatenate(side) for side in zip(*held)))
        return pd.DataFrame({"vertex": vertices, "parent": least})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, at = [], 0, None
        for pdf in frames:
            if not len(pdf):
                continue
            row, column, a, b = (pdf[c].to_numpy() for c in ("row", "column", "a", "b"))
            cuts = [0, *(np.flatnonzero((row[1:] != row[:-1]) | (column[1:] != column[:-1])) + 1).tolist(), len(pdf)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if held and (at != (row[i], column[i]) or size >= limit):
                    yield solve(held)
                    held, size = [], 0
                at = (row[i], column[i])
                held.append((a[i:j], b[i:j]))
                size += j - i
        if held:
            yield solve(held)

    return run


def lookup(rows: DataFrame, key: str, table: DataFrame, size: int) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row a key, columns key and top); ``size`` is a bound of the number of rows.

    Keys of many rows, fewer than HOT a task, meet their row by broadcast and are never gathered.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > max(CELL_EDGES, size // (HOT * tasks))).select(key)
    few = table.join(F.broadcast(hot), key, "left_semi").withColumn("hot", F.lit(True))
    marked = rows.join(F.broadcast(few), key, "left")
    cold = marked.where("hot is null").drop("top", "hot").join(table, key, "left")
    return marked.where("hot").drop("hot").unionByName(cold)


def flattened(parents: DataFrame, size: int) -> DataFrame:
    """vertex, parent with every parent a root: each jump halves the depth of the trees."""
    while True:
        up = parents.select(F.col("vertex").alias("parent"), F.col("parent").alias("top"))
        jumped = lookup(parents.select("vertex", "parent"), "parent", up, size)
        parents = materialise(jumped.select("vertex", F.coalesce("top", "parent").alias("parent"), (F.col("top") < F.col("parent")).alias("moved")))
        if not parents.where("moved").limit(1).count():
            return parents.select("vertex", "parent")


def components(edges: DataFrame, a: str = "a", b: str = "b", cell_edges: int = CELL_EDGES, first_grid: int = FIRST_GRID) -> DataFrame:
    """Columns vertex, component (the least vertex of the component), for every vertex with an edge to another one.

    Edges with a null end and loops link nothing; repeated and reversed edges count once; no edges give no rows; other
    columns are ignored. Up to ``cell_edges`` edges left after a round fit one cell, which ends the rounds.
    """
    plain = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    live = materialise(plain.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[tuple[DataFrame, int]] = []
    left = live.count()
    while left:
        grid = math.ceil(math.sqrt(left / cell_edges))
        grid = grid if levels else max(first_grid, grid)
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(grid)).cast("int")  # noqa: B023, E731
        placed = live.select("a", "b", block("a").alias("row"), block("b").alias("column"))
        placed = placed.repartition("row", "column").sortWithinPartitions("row", "column")
        found = placed.mapInPandas(cells(cell_edges), "vertex bigint, parent bigint")
        if grid == 1 and left <= cell_edges:
            levels.append((found.groupBy("vertex").agg(F.min("parent").alias("parent")), 2 * left))
            break
        # a vertex is in 2 * grid - 1 cells at most, a hub in as many pieces as its cells have, which bounds the set
        seen = materialise(found.groupBy("vertex").agg(F.collect_set("parent").alias("parents")).select(F.array_min("parents").alias("parent"), "vertex", "parents"))
        roots = flattened(seen, 2 * left)
        levels.append((roots, 2 * left))
        links = seen.select(F.col("parent").alias("x"), F.explode("parents").alias("y")).where("x <> y").distinct()
        root_of = roots.select("vertex", F.col("parent").alias("top"))
        ends = lambda rows, end, name: lookup(rows, end, root_of.withColumnRenamed("vertex", end), 2 * left).withColumnRenamed("top", name)  # noqa: B023, E731
        joined = ends(ends(links, "x", "p"), "y", "q").where("p <> q")
        live = materialise(joined.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
        left = live.count()
    if not levels:
        return live.select(F.col("a").alias("vertex"), F.col("b").alias("component")).limit(0)
    labels, _ = levels.pop()
    while levels:
        upper = labels.select(F.col("vertex").alias("parent"), F.col("parent").alias("top"))
        lower, size = levels.pop()
        labels = lookup(lower, "parent", upper, size).select("vertex", F.coalesce("top", "parent").alias("parent"))
    return labels.select("vertex", F.col("parent").alias("component"))


def pair_groups(candidates: DataFrame, cell_edges: int = CELL_EDGES) -> DataFrame:
    """channel_id and family_key (the least id) of every channel that confirmed pairs link to another one."""
    confirmed = current_pairs(candidates).where("decision = 'confirmed'")
    return components(confirmed, cell_edges=cell_edges).select(F.col("vertex").alias("channel_id"), F.col("component").alias("family_key"))

