"""Queries of the problems tagged llm (p2, p4, p5, p7, p8, p9) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import components, language, leakage, pii, quantiles, tokens
from tidewire.operators import families
from tidewire.plans.problems import BARE, PAIRS
from tidewire.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.pair_groups(table(spark, folder, "affiliation_candidates"))


def p2_changes(spark: SparkSession, folder: str) -> DataFrame:
    return families.family_changes(table(spark, folder, "channel_families"), p2_found(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.mislabelled(table(spark, folder, "raw_messages"), table(spark, folder, "post_labels"))


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each stretch of every message and cited post with its language and confidence."""
    raw = table(spark, folder, "raw_messages")
    net = language.fit_network(raw, table(spark, folder, "post_labels"))
    texts = language.texts_once(raw, table(spark, folder, "cited_posts"))
    read = language.read_texts(texts, ["channel_id", "msg_id"], net).select("channel_id", "msg_id", F.explode("segments").alias("s"))
    return read.select("channel_id", "msg_id", "s.start", "s.stop", "s.lang", F.round("s.confidence", 6).alias("confidence"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.wrong_medians(table(spark, folder, "cited_posts"), table(spark, folder, "channel_scorecard"))


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Views of all posts of both tables: sketches of either, combined."""
    cited = table(spark, folder, "cited_posts").select("channel_id", "msg_id", "views")
    raw = table(spark, folder, "raw_messages")
    views = F.from_json("payload", "`_` string, views bigint")
    fetched = raw.select("channel_id", "msg_id", "fetched_at", views.alias("p")).where("p._ = 'Message'").select("channel_id", "msg_id", F.col("p.views").alias("views"), "fetched_at")
    last = fetched.groupBy("channel_id", "msg_id").agg(F.max(F.struct("fetched_at", "views")).alias("m")).select("channel_id", "msg_id", F.col("m.views").alias("views"))
    both = cited.groupBy("channel_id", "msg_id").agg(F.max("views").alias("cited")).join(last, ["channel_id", "msg_id"], "full")
    posts = both.select("channel_id", "msg_id", F.coalesce("cited", "views").alias("views"))
    return quantiles.percentiles(posts).withColumnRenamed("source", "channel_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and characters of each source."""
    documents = table(spark, folder, "documents")
    counts = tokens.encode(documents.select("source", "text"), key="source").groupBy("source")
    return counts.agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose ids do not decode to their text: none, unless a text is not valid Unicode."""
    documents = table(spark, folder, "documents")
    back = tokens.decode(tokens.encode(documents)).withColumnRenamed("text", "decoded")
    return documents.join(back, "doc_id").where(F.coalesce("text", F.lit("")) != F.col("decoded")).select("doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_passages(spark, folder).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents")).select("doc_id", F.explode("mentions").alias("m")).where(~F.col("m.kind").isin("card", "iban"))
    return found.select("doc_id", "m.kind", "m.start_pos").distinct()


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents")).select("doc_id", "redacted", F.size("mentions").alias("mentions"))


QUERIES = {f.__name__: f for f in (p2_found, p2_changes, p4_found, p4_segments, p5_found, p5_percentiles, p7_ids, p7_counts, p7_round_trip, p8_found, p8_passages, p9_found, p9_redacted)}
ORACLES = {
    "p2_found": f"with recursive {PAIRS} select * from fresh",
    "p2_changes": f"""with recursive {PAIRS}, o as (select distinct {BARE.format("channel_id")} channel_id, {BARE.format("family_key")} old_key from channel_families)
select coalesce(o.channel_id, f.channel_id) channel_id, old_key, f.family_key new_key, case when old_key is null then 'added' when f.family_key is null then 'removed' else 'moved' end change
from o full join fresh f on o.channel_id = f.channel_id where old_key is distinct from f.family_key""",
    "p5_found": """with m as (select channel_id, median(v) m from (select channel_id, msg_id, max(views)::double v from cited_posts group by all) where v is not null group by 1)
select distinct tg_id from channel_scorecard join m on channel_id = tg_id where median_views is null or isnan(median_views) or abs(median_views - m) > 0.2 * abs(m)""",
    "p7_round_trip": "select doc_id from documents where false",
}
