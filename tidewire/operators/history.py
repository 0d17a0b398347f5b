"""Histories of changing attributes by tree-reduction coalescing.

Each snapshot is a unit interval of (attribute, entity, value): a run with a start, the moment it was last seen and a count.
Blocks of neighbouring runs merge pairwise, block sizes doubling each round; where the last run of the left block and the
first of the right one agree in attribute, entity and value they become one interval. Merging is associative, so the runs of
a batch, of a partition (an entity with a third of all snapshots covers several) and of the partitions' ends all go through
the same reduction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import materialise

PAYLOAD = "full_chat struct<id: bigint, about: string>, chats array<struct<id: bigint, title: string, username: string>>, broken string"
ATTRIBUTES = ("username", "title", "about")
KEYS = ["attr", "entity", "value"]


def reduce_runs(runs: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
    """Coalesce neighbouring runs (attr, entity, value, since, seen, units) that agree: the runs left, which rows they are, the rounds.

    Every round halves the number of blocks; only the seams between the two blocks of a pair are looked at.
    """
    keys = [runs[k].to_numpy(dtype=object if k != "entity" else None) for k in KEYS]
    seen, units = runs["seen"].to_numpy().copy(), runs["units"].to_numpy().copy()
    alive = np.ones(len(runs), dtype=bool)
    first = last = np.arange(len(runs))
    rounds = 0
    while len(first) > 1:
        even = len(first) // 2 * 2
        left, right, end = last[0:even:2], first[1:even:2], last[1:even:2].copy()
        same = np.ones(len(left), dtype=bool)
        for k in keys:
            same &= k[left] == k[right]
        into, gone = left[same], right[same]
        alive[gone] = False
        seen[into] = seen[gone]
        units[into] += units[gone]
        single = same & (end == right)  # the right block was one run, which is now part of the left one
        end[single] = left[single]
        first, last = np.append(first[0:even:2], first[even:]), np.append(end, last[even:])
        rounds += 1
    return runs.assign(seen=seen, units=units)[alive], np.flatnonzero(alive), rounds


RUNS = "pid int, seq bigint, attr string, entity bigint, value string, since bigint, seen bigint, units bigint"


def coalesce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one sorted partition, numbered within their attribute; memory holds one batch and the run that reaches over its end."""
    held, pid, attr, at = None, 0, None, 0

    def numbered(runs: pd.DataFrame) -> pd.DataFrame:
        nonlocal attr, at
        name = runs["attr"].to_numpy(dtype=object)
        seq = np.empty(len(runs), dtype="int64")
        cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(runs)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            at = at if name[i] == attr else 0
            seq[i:j] = np.arange(at, at + j - i)
            attr, at = name[i], at + j - i
        return runs.assign(pid=np.int32(pid), seq=seq)[[c.split()[0] for c in RUNS.split(", ")]]

    for pdf in frames:
        if not len(pdf):
            continue
        pid = int(pdf["pid"].iloc[0])
        plain = pdf["value"].to_numpy(dtype=object)
        value = np.array([v if v is None or v.isascii() else unicodedata.normalize("NFC", v) for v in plain], dtype=object)
        unit = pd.DataFrame({"attr": pdf["attr"], "entity": pdf["entity"], "value": value, "since": pdf["at"], "seen": pdf["at"], "units": np.ones(len(pdf), dtype="int64")})
        runs, _, _ = reduce_runs(unit if held is None else pd.concat([held, unit], ignore_index=True))
        held = runs.iloc[-1:]
        if len(runs) > 1:
            yield numbered(runs.iloc[:-1])
    if held is not None:
        yield numbered(held)


ENDS = RUNS + ", runs bigint"


def ends_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first, second and last run of each attribute of a partition, and how many there are: the most that its neighbours need."""
    kept: dict[str, list] = {}
    for pdf in frames:
        for attr, own in pdf.groupby("attr", sort=False):
            few = own[own["seq"] < 2].to_dict("records")
            start = [*kept.get(attr, []), *few][:2]
            kept[attr] = [*start, own.iloc[-1].to_dict()]
    if kept:
        yield pd.DataFrame([r | {"runs": x[-1]["seq"] + 1} for x in kept.values() for r in {r["seq"]: r for r in x}.values()])


SEAMS = "pid int, attr string, runs bigint, drop boolean, after bigint, seen_last bigint, units_last bigint"


def seams(ends: pd.DataFrame) -> pd.DataFrame:
    """For one attribute and each partition: whether its first run continues the one before, and how its last run goes on.

    At most four rows a partition come together here: its ends and a gap, which keeps apart runs that are no neighbours.
    """
    ends = ends.sort_values(["pid", "seq"])
    gaps = ends[(ends["seq"] == ends["runs"] - 1) & (ends["runs"] > 3)].assign(entity=np.iinfo("int64").min, seq=2)
    gaps["value"] = "gap " + gaps["pid"].astype(str)
    rows = pd.concat([ends, gaps]).sort_values(["pid", "seq"], kind="stable").reset_index(drop=True)
    left, where, _ = reduce_runs(rows)
    owner = np.searchsorted(where, np.arange(len(rows)), side="right") - 1  # the run left that each row is part of
    entity, since = left["entity"].to_numpy(), left["since"].to_numpy()
    seen, units = left["seen"].to_numpy(), left["units"].to_numpy()
    stays = np.isin(np.arange(len(rows)), where)
    out = []
    last_row = rows.groupby("pid").tail(1).index.to_numpy()
    first_row = rows.groupby("pid").head(1).index.to_numpy()
    for a, b in zip(first_row, last_row):
        k = owner[b]
        after = int(since[k + 1]) if k + 1 < len(left) and entity[k + 1] == entity[k] else None
        out.append((int(rows["pid"][a]), rows["attr"][a], int(rows["runs"][a]), not stays[a], after, int(seen[k]), int(units[k])))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SEAMS.split(", ")]).astype({"after": "Int64"})


HISTORY = "entity bigint, attr string, value string, valid_from_s bigint, valid_to_s bigint, last_seen_s bigint, snapshots bigint"


def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Give every run its end: the start of the entity's next version, open for the last."""

    def finish(rows: pd.DataFrame, n: int) -> pd.DataFrame:
        attr, entity, since = rows["attr"].to_numpy(dtype=object), rows["entity"].to_numpy(), rows["since"].to_numpy()
        to = pd.array(np.full(len(rows), None, dtype=object), dtype="Int64")
        near = np.flatnonzero((attr[1:] == attr[:-1]) & (entity[1:] == entity[:-1]))
        to[near] = since[near + 1]
        last = (rows["seq"] == rows["runs"] - 1).to_numpy()
        to[last] = rows["after"].astype("Int64").array[last]
        out = pd.DataFrame({"entity": entity, "attr": attr, "value": rows["value"], "valid_from_s": since, "valid_to_s": to})
        out["last_seen_s"] = np.where(last, rows["seen_last"], rows["seen"])
        out["snapshots"] = np.where(last, rows["units_last"], rows["units"])
        return out[:n][~((rows["seq"] == 0) & rows["drop"]).to_numpy(dtype=bool)[:n]]

    held = None
    for pdf in frames:
        if not len(pdf):
            continue
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if len(rows) > 1:
            yield finish(rows, len(rows) - 1)
        held = rows.iloc[-1:].reset_index(drop=True)
    if held is not None:
        yield finish(held, 1)


def placed_by_time(rows: DataFrame) -> DataFrame:
    """Rows with entity and at, ranged by them, and the partition they are in; nothing above is evaluated before they move."""
    known = rows.where("entity is not null and at is not null")
    return known.repartitionByRange("entity", "at").withColumn("pid", F.spark_partition_id())


def versions(units: DataFrame) -> DataFrame:
    """The history of units (entity bigint, attr string, at bigint, value string): one row a version, the last one open.

    Also the moment each version was last seen and its number of snapshots. Snapshots of one moment are taken in the order
    of their values, so repeats merge; a null value is a version too; units without entity, attribute or moment are left
    out; no units give no rows; other columns are ignored. The attributes are few: columns of one kind of snapshot.
    """
    return coalesced(placed_by_time(units.select("entity", "attr", "at", "value").where("attr is not null")))


def coalesced(placed: DataFrame) -> DataFrame:
    """The history of units that ``placed_by_time`` has put in place."""
    ordered = placed.select("pid", "attr", "entity", "at", "value").sortWithinPartitions("attr", "entity", "at", "value")
    runs = materialise(ordered.mapInPandas(coalesce, RUNS))
    around = runs.mapInPandas(ends_of, ENDS).groupBy("attr").applyInPandas(seams, SEAMS)  # a row a partition and attribute
    return runs.join(F.broadcast(around), ["pid", "attr"]).mapInPandas(close, HISTORY)


def blank_as_null(c):
    """Any amount and kind of white space is one space; nothing else than white space is null."""
    spaced = F.trim(F.regexp_replace(c, r"[\s\p{Z}\x{85}\x{200b}\x{2060}\x{feff}]+", " "))
    return F.when(spaced != "", spaced)


def channel_snapshots(raw: DataFrame) -> DataFrame:
    """Attribute values of the fetches that did not fail, as units in place: documents move once and are parsed after that.

    A fetch fails where the payload is null, cut off, without a channel record, or another channel's record.
    """
    options = {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}
    at = F.floor(F.unix_micros(F.col("fetched_at").cast("timestamp")) / 1_000_000).cast("long")
    placed = placed_by_time(raw.select(F.col("channel_id").cast("long").alias("entity"), at.alias("at"), "payload").where("payload is not null"))
    parsed = placed.select("pid", "entity", "at", F.from_json("payload", PAYLOAD, options).alias("p"))
    chat = F.get("p.chats", F.lit(0))
    good = parsed.where("p is not null and p.broken is null and p.full_chat.id = entity").where(chat.isNull() | chat["id"].isNull() | (chat["id"] == F.col("entity")))
    username = F.trim(F.regexp_replace(F.lower(blank_as_null(chat["username"])), r"^@+", ""))
    values = {"username": F.when(username != "", username), "title": blank_as_null(chat["title"]), "about": blank_as_null(F.col("p.full_chat.about"))}
    wide = good.select("pid", "entity", "at", *[v.alias(k) for k, v in values.items()])
    return wide.selectExpr("pid", "entity", "at", "stack(3, 'username', username, 'title', title, 'about', about) as (attr, value)")


def channel_history(raw: DataFrame) -> DataFrame:
    """channel_id, attr, value, valid_from_s, valid_to_s, last_seen_s, snapshots of every version of username, title and about."""
    return coalesced(channel_snapshots(raw)).withColumnRenamed("entity", "channel_id")
