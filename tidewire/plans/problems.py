"""Queries of the general data problems (p1, p3, p6) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import history, references, spikes
from tidewire.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible_posts(table(spark, folder, "cited_posts"))


def p1_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = spikes.flag_numbers(table(spark, folder, "cited_posts"), "channel_id", "msg_id")
    return rows.withColumnsRenamed({"source": "channel_id", "position": "msg_id"}).withColumn("p_odd", F.round("p_odd", 6))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return references.heavy_channels(table(spark, folder, "edges"), table(spark, folder, "channels"))


def p3_references(spark: SparkSession, folder: str) -> DataFrame:
    return references.reference_counts(table(spark, folder, "edges"), table(spark, folder, "channels")).withColumn("share", F.round("share", 9))


def p3_target_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return references.kinds_referred_to(table(spark, folder, "edges"), table(spark, folder, "channels"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_history(spark, folder).select("channel_id", "attr", "valid_from_s")


def p6_history(spark: SparkSession, folder: str) -> DataFrame:
    return history.channel_history(table(spark, folder, "raw_channels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_flags, p3_found, p3_references, p3_target_kinds, p6_found, p6_history)}

BARE = "case when {0} < -1000000000000 then -{0} - 1000000000000 else {0} end"

POSTS = "(select channel_id, msg_id, max(views)::double v, max(forwards)::double f, max(reactions)::double r from cited_posts group by all)"

ODD = """select distinct channel_id, msg_id from (
  select channel_id, msg_id, v, f, r, median(v) over c mv, median(f) over c mf, median(r) over c mr,
         count(*) over (partition by channel_id, v, gv) nv, count(*) over (partition by channel_id, f, gf) nf, count(*) over (partition by channel_id, r, gr) nr
  from (select *, row_number() over (partition by channel_id order by msg_id) - row_number() over (partition by channel_id, v order by msg_id) gv,
               row_number() over (partition by channel_id order by msg_id) - row_number() over (partition by channel_id, f order by msg_id) gf,
               row_number() over (partition by channel_id order by msg_id) - row_number() over (partition by channel_id, r order by msg_id) gr
        from posts) window c as (partition by channel_id))
where v < 0 or f < 0 or r < 0 or f > v or r > v
   or (v >= 50 and (v >= 10 * mv or nv > 3)) or (f >= 50 and (f >= 10 * mf or nf > 3)) or (r >= 50 and (r >= 10 * mr or nr > 3))"""

PAIRS = f"""pairs as (
  select least(x, y) a, greatest(x, y) b, arg_max(d, run_id) d
  from (select {BARE.format("channel_a")} x, {BARE.format("channel_b")} y, lower(trim(decision)) d, run_id from affiliation_candidates)
  where x <> y group by 1, 2),
links as (select a, b from pairs where d = 'confirmed' union select b, a from pairs where d = 'confirmed'),
reach(v, r) as (select a, a from links union select l.b, t.r from reach t join links l on l.a = t.v),
fresh as (select v channel_id, min(r) family_key from reach group by v)"""

EDGES = f"e as (select distinct {BARE.format('src_channel_id')} s, msg_id, kind, {BARE.format('dst_channel_id')} d, dst_msg_id from edges)"

COUNTS = f"""with {EDGES}, c as (
  select 'src' side, s channel_id, count(*)::bigint refs, count(*) filter (kind = 'forward')::bigint forwards from e where s is not null group by s
  union all select 'dst', d, count(*)::bigint, count(*) filter (kind = 'forward')::bigint from e where d is not null group by d),
w as (select *, refs / sum(refs) over (partition by side) sh from c)"""

SNAPSHOTS = r"""good as (
  select channel_id, epoch_us(fetched_at) // 1000000 at_s, json_extract_string(j, '$.chats[0].username') u, json_extract_string(j, '$.chats[0].title') t, json_extract_string(j, '$.full_chat.about') a
  from (select channel_id, fetched_at, case when json_valid(payload) then payload::json end j from raw_channels)
  where j is not null and json_extract_string(j, '$.full_chat.id') = channel_id::varchar and coalesce(json_extract_string(j, '$.chats[0].id'), channel_id::varchar) = channel_id::varchar),
units as (
  select channel_id, at_s, 'username' attr, nullif(trim(regexp_replace(lower(trim(regexp_replace(u, '[\s\x{a0}]+', ' ', 'g'))), '^@+', '')), '') val from good
  union all select channel_id, at_s, 'title', nfc_normalize(nullif(trim(regexp_replace(t, '[\s\x{a0}]+', ' ', 'g')), '')) from good
  union all select channel_id, at_s, 'about', nfc_normalize(nullif(trim(regexp_replace(a, '[\s\x{a0}]+', ' ', 'g')), '')) from good),
numbered as (select *, row_number() over () rid from units),
heads as (
  select *, row_number() over w = 1 or val is distinct from lag(val) over w head from numbered window w as (partition by channel_id, attr order by at_s, val nulls first, rid)),
islands as (select *, sum(head::int) over (partition by channel_id, attr order by at_s, val nulls first, rid) k from heads),
history as (
  select channel_id, attr, any_value(val) "value", min(at_s) valid_from_s, lead(min(at_s)) over (partition by channel_id, attr order by k) valid_to_s, max(at_s) last_seen_s, count(*)::bigint snapshots
  from islands group by channel_id, attr, k)"""

ORACLES = {
    "p1_found": f"with posts as {POSTS} {ODD}",
    "p3_found": f"{COUNTS} select side, channel_id from w where sh >= 0.02",
    "p3_references": f"""{COUNTS}, inv as (select {BARE.format("tg_id")} channel_id, min(kind) kind, true known from channels where tg_id is not null group by 1)
select side, channel_id, kind, coalesce(known, false) known, refs, forwards, round(sh, 9) "share", sh >= 0.02 heavy from w left join inv using (channel_id)""",
    "p3_target_kinds": f"""with {EDGES}, k as (select {BARE.format("tg_id")} d, min(kind) kind_of_target from channels where kind is not null group by 1)
select s src_channel_id, kind_of_target, count(*)::bigint refs from e join k using (d) group by 1, 2""",
    "p6_found": f"with {SNAPSHOTS} select channel_id, attr, valid_from_s from history",
    "p6_history": f"with {SNAPSHOTS} select * from history",
}
