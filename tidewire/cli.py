"""Command line: ``python -m tidewire COMMAND --data FOLDER [--out PATH]`` over a folder of Parquet tables.

Each command names a query or a pass; its result is written to ``--out`` or its first rows are shown.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import payload
from tidewire.operators import baselines, cascades, communities, derive, families, queues, rankings, records, reports, signals
from tidewire.plans import domain
from tidewire.plans import reports as plan_reports
from tidewire.session import build
from tidewire.sources import sinks, store
from tidewire.sources.tables import table


def do_derive(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = derive.derive(table(spark, a.data, "raw_messages"), table(spark, a.data, "channels")).edges
    return found if a.rebuild else derive.missing_edges(found, table(spark, a.data, "edges"))


def do_alerts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    params = cascades.CascadeParams(tuple(a.bands), a.window)
    return cascades.crossings(domain.reposts(spark, a.data), params, F.to_timestamp(F.lit(a.now)) if a.now else None)


def do_baselines(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return baselines.fit(readings(spark, a), params(a))


def do_score(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows, p = readings(spark, a), params(a)
    moment = lambda text: F.to_timestamp(F.lit(text)) if text else None
    return baselines.spikes(baselines.scores(rows, baselines.fit(rows, p), baselines.mature_medians(rows, p), p, moment(a.since), moment(a.replay or a.now)), p)


def params(a: argparse.Namespace) -> baselines.BaselineParams:
    return baselines.BaselineParams(threshold=a.threshold)


def readings(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return baselines.readings(payload.observations(table(spark, a.data, "raw_messages")), baselines.scope(domain.channels(spark, a.data)), params(a))


def do_affiliates(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A fresh run, or with --stored the stored candidates; pairs with a seed that are undecided, unless told otherwise."""
    known = domain.channels(spark, a.data)
    if a.stored:
        rows = plan_reports.candidate_rows(spark, a.data)
    else:
        t = signals.Thresholds(a.min_out_edges, a.max_share_min, a.min_token_length, a.max_token_channels, a.min_mutual_edges, a.max_handle_token_channels)
        w = signals.Weights(a.about, a.handle, a.share, a.token, a.mutual)
        edges = domain.edges(spark, a.data)
        edges = edges.where(F.col("kind") == a.edge_kind) if a.edge_kind else edges
        found = signals.detect(known, domain.about(spark, a.data), edges, domain.family(spark, a.data), t, w)
        decided = families.current_pairs(table(spark, a.data, "affiliation_candidates")).select(F.col("a").alias("channel_a"), F.col("b").alias("channel_b"), "decision")
        rows = found.join(decided, ["channel_a", "channel_b"], "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))
    return reports.evidence_line(reports.list_candidates(rows, known, decided=a.all, seeds_only=not a.any_status, limit=a.limit))


def do_family(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The families; with --confirm, --reject or --withdraw and ids, the decisions after that."""
    stored = families.current_pairs(table(spark, a.data, "affiliation_candidates")).select(F.col("a").alias("channel_a"), F.col("b").alias("channel_b"), "decision")
    for decision, ids in (("confirmed", a.confirm), ("rejected", a.reject), ("withdrawn", a.withdraw)):
        if ids:
            members = spark.createDataFrame([(0, i) for i in ids], "`group` int, tg_id bigint")
            return queues.decide(stored, queues.all_pairs(members), decision)
    return domain.family(spark, a.data)


def do_channels(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = reports.list_channels(domain.channels(spark, a.data), domain.family(spark, a.data), a.status, a.family)
    return queues.find_channel(rows, a.ref) if a.ref else rows


def do_add(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Entries of a text file that are usernames and that no channel holds yet; with --failures, the lines that are none."""
    read = store.read_entries(spark, a.entries)
    if a.failures:
        return read.where("username is null").select("entry")
    held = domain.channels(spark, a.data).select(F.lower("username").alias("username")).distinct()
    return read.where("username is not null").select("username").distinct().join(held, "username", "left_anti")


def do_mark(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The inventory after one channel's review."""
    known = domain.channels(spark, a.data)
    one = queues.find_channel(known, a.ref).select("tg_id", F.lit(a.status).alias("status"), F.lit(a.kind).cast("string").alias("kind"), F.lit(a.reason).cast("string").alias("reason"))
    return queues.mark(known, one)


def do_floods(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Recent rate limits of the table floods (method, seconds, at, halted), or with --summary the tally of each method."""
    rows = table(spark, a.data, "floods")
    return queues.flood_summary(rows).orderBy(F.desc("floods"), "method") if a.summary else records.recent_floods(rows, a.limit)


def do_metadata(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Channels whose snapshot is missing or too old."""
    snapshots = table(spark, a.data, "raw_channels").select(F.col("channel_id").alias("tg_id"), "fetched_at")
    return queues.metadata_due(queues.in_scope(domain.channels(spark, a.data)).select("tg_id"), snapshots, F.to_timestamp(F.lit(a.now or domain.NOW)), a.max_age)


def do_watch_status(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return queues.lag(queues.in_scope(domain.channels(spark, a.data)).select("tg_id"), domain.poll_state(spark, a.data), F.to_timestamp(F.lit(a.now or domain.NOW)))


def do_report(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The sections of one channel's report as lines of Markdown in order."""
    known, family, edges, posts = domain.channels(spark, a.data), domain.family(spark, a.data), domain.edges(spark, a.data), payload.posts(table(spark, a.data, "raw_messages"))
    one = queues.find_channel(known, a.ref).select("tg_id").first()["tg_id"]
    own = reports.affiliated_section(family, known, posts)
    key = own.where(F.col("channel_id") == one).select("family_key")
    sections = [
        ("Collected", reports.collected_spans(posts.where(F.col("channel_id") == one)).drop("channel_id")),
        ("Referenced by", reports.incoming_section(edges, known, family).where(F.col("dst_channel_id") == one).drop("dst_channel_id").orderBy(F.desc("forwards"), F.desc("mentions"), "title")),
        ("References", reports.outgoing_section(edges, family).where(F.col("src_channel_id") == one).drop("src_channel_id").orderBy("kind")),
        ("Posts that travelled", reports.travelled_section(edges, known, family).where(F.col("dst_channel_id") == one).drop("dst_channel_id").orderBy(F.desc("families"), F.desc("sources"), F.desc("published_at")).limit(20)),
        ("Other channels of the author", own.where(F.col("channel_id") != one).join(key, "family_key").select("title", "username", "posts").orderBy(F.desc("posts"), "title")),
    ]
    return sinks.document(spark, sections)


def do_resolve(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = derive.derive(table(spark, a.data, "raw_messages"), table(spark, a.data, "channels"))
    rows = derive.pending_queue(found.pending, domain.channels(spark, a.data), a.min_sources)
    return rows.limit(a.limit) if a.limit else rows


def do_watch(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return queues.due(queues.in_scope(domain.channels(spark, a.data)).select("tg_id"), domain.poll_state(spark, a.data), F.to_timestamp(F.lit(a.now or domain.NOW)))


def do_graph(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    pairs = communities.decayed_pairs(domain.edges(spark, a.data), F.to_timestamp(F.lit(a.now or domain.NOW)), 90.0)
    return sinks.gexf(*communities.graph_export(pairs, domain.channels(spark, a.data)))


def do_scorecard(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return domain.scorecard(spark, a.data)


def do_style(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return rankings.style_scores(rankings.text_measures(payload.posts(table(spark, a.data, "raw_messages"))))


def do_query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from tidewire.plans import problems
    from tidewire.plans import records as plan_records

    return (problems.QUERIES | domain.QUERIES | plan_records.QUERIES | plan_reports.QUERIES)[a.name](spark, a.data)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewire", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    t, w = signals.Thresholds(), signals.Weights()
    options: dict[str, list[tuple]] = {
        "derive": [("--rebuild", {"action": "store_true"})],
        "alerts": [("--window", {"type": float, "default": 6.0}), ("--bands", {"type": int, "nargs": "+", "default": [2, 3]})],
        "baselines": [("--threshold", {"type": float, "default": 3.3})], "score": [("--threshold", {"type": float, "default": 3.3}), ("--since", {}), ("--replay", {})],
        "affiliates": [(f"--{k.replace('_', '-')}", {"type": type(getattr(o, k)), "default": getattr(o, k)}) for o in (t, w) for k in o.__dataclass_fields__]
        + [("--edge-kind", {"choices": ("forward", "mention")}), ("--limit", {"type": int}), ("--all", {"action": "store_true"}), ("--any-status", {"action": "store_true"}), ("--stored", {"action": "store_true"})],
        "family": [(f"--{k}", {"type": int, "nargs": "+"}) for k in ("confirm", "reject", "withdraw")], "channels": [("--status", {}), ("--ref", {}), ("--family", {"type": int})],
        "resolve": [("--min-sources", {"type": int, "default": 1}), ("--limit", {"type": int})], "add": [("entries", {}), ("--failures", {"action": "store_true"})],
        "mark": [("ref", {}), ("--status", {"required": True}), ("--kind", {}), ("--reason", {})], "floods": [("--summary", {"action": "store_true"}), ("--limit", {"type": int, "default": 50})],
        "metadata": [("--max-age", {"type": float, "default": 14})], "watch-status": [], "report": [("ref", {})], "watch": [], "graph": [], "scorecard": [], "style": [], "query": [("name", {})],
    }
    for name, extra in options.items():
        p = sub.add_parser(name)
        for flag, how in extra:
            p.add_argument(flag, **how)
        p.add_argument("--data", required=True)
        p.add_argument("--out")
        p.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
        p.add_argument("--now")
        p.add_argument("--master")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or build(a.master)
    df = globals()[f"do_{a.command.replace('-', '_')}"](spark, a)
    if not a.out:
        df.show(20, truncate=80)
    elif a.command in ("graph", "report"):
        df.write.mode("overwrite").text(a.out)
    else:
        sinks.sheet(df, a.out, a.format)
