"""Queries of listings, report sections, sheets and text forms, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import payload, text
from tidewire.operators import cascades, communities, families, queues, rankings, reports
from tidewire.plans import domain
from tidewire.plans.domain import at, channels, edges, epoch, family, raw, rounded
from tidewire.plans.domain_sql import ABOUT, ANOMALY, DECAYED, EDGES, INVENTORY, KINDS, NOW, POSTS, REPOSTS
from tidewire.plans.problems import PAIRS
from tidewire.sources import store
from tidewire.sources.tables import table


def posts(spark: SparkSession, folder: str) -> DataFrame:
    return payload.posts(raw(spark, folder))


# ---------------------------------------------------------------- channels and sections


def volume_shares(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reports.volume_shares(posts(spark, folder), channels(spark, folder)))


def collected_spans(spark: SparkSession, folder: str) -> DataFrame:
    return reports.collected_spans(posts(spark, folder)).select("channel_id", "posts", epoch("first_at"), epoch("last_at"))


def watched_spans(spark: SparkSession, folder: str) -> DataFrame:
    return reports.watched_spans(payload.observations(raw(spark, folder))).select("channel_id", "readings", "posts", epoch("first_at"), epoch("last_at"))


def incoming_section(spark: SparkSession, folder: str) -> DataFrame:
    return reports.incoming_section(edges(spark, folder), channels(spark, folder), family(spark, folder)).withColumn("last_at", F.unix_seconds(F.col("last_at").cast("timestamp")))


def outgoing_section(spark: SparkSession, folder: str) -> DataFrame:
    return reports.outgoing_section(edges(spark, folder), family(spark, folder))


def travelled_section(spark: SparkSession, folder: str) -> DataFrame:
    rows = reports.travelled_section(edges(spark, folder), channels(spark, folder), family(spark, folder))
    return rows.select("dst_channel_id", "dst_msg_id", epoch("published_at"), "families", "sources")


def affiliated_section(spark: SparkSession, folder: str) -> DataFrame:
    return reports.affiliated_section(family(spark, folder), channels(spark, folder), posts(spark, folder))


def count_families(spark: SparkSession, folder: str) -> DataFrame:
    return reports.count_families(family(spark, folder))


def seed_families(spark: SparkSession, folder: str) -> DataFrame:
    """The inventory's seeds with the family of each."""
    return reports.list_channels(channels(spark, folder), family(spark, folder), status="seed").select("tg_id", "family_key")


def candidate_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of each pair as candidates."""
    from tidewire.functions.ids import bare_id, ordered_pair

    low, high = ordered_pair(bare_id("channel_a"), bare_id("channel_b"))
    columns = ["score", "about_direction", "shared_token", "shared_token_channels", "handle_token", "handle_token_channels", "out_share", "out_share_edges", "edges_a_to_b", "edges_b_to_a"]
    rows = table(spark, folder, "affiliation_candidates").select(low.alias("a"), high.alias("b"), bare_id("channel_a").alias("x"), bare_id("channel_b").alias("y"), "run_id", F.lower(F.trim("decision")).alias("decision"), *columns)
    last = rows.where("x is not null and y is not null and x <> y").groupBy("a", "b").agg(F.max(F.struct("run_id", "decision", *columns)).alias("r"))
    return last.select(F.col("a").alias("channel_a"), F.col("b").alias("channel_b"), "r.*")


def listed_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = reports.list_candidates(candidate_rows(spark, folder), channels(spark, folder), decided=True, seeds_only=False)
    return rows.select("channel_a", "channel_b", F.round("score", 9).alias("score"), "decision", "username_a", "username_b", "status_a", "status_b")


def open_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The pending pairs with a seed that lead the list."""
    return reports.list_candidates(candidate_rows(spark, folder), channels(spark, folder), limit=20).select("channel_a", "channel_b", F.round("score", 9).alias("score"))


def evidence_lines(spark: SparkSession, folder: str) -> DataFrame:
    return reports.evidence_line(candidate_rows(spark, folder)).select("channel_a", "channel_b", "line")


def handle_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return reports.handle_blocks(candidate_rows(spark, folder))


def cited_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return cascades.crossings(domain.reposts(spark, folder), domain.CASCADE).where("band = 1")


def alert_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = reports.alert_evidence(cited_alerts(spark, folder), posts(spark, folder), channels(spark, folder), edges(spark, folder), 240)
    return rows.select("channel_id", "msg_id", "username", epoch("published"), F.length("text").cast("bigint").alias("chars"), "carrier_username")


def clustered_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    """The stored scorecard with the place of the kind as cluster, from a sheet of every other channel."""
    known = channels(spark, folder).where(F.pmod("tg_id", F.lit(2)) == 0)
    sheet = known.select("username", F.array_position(F.array(*[F.lit(k) for k in domain.KINDS]), F.col("kind")).alias("cluster"))
    return reports.with_clusters(table(spark, folder, "channel_scorecard").select("tg_id", "username"), sheet).select("tg_id", "username", "cluster")


def stated_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of stated posts in the order named; the last one is not stored."""
    return reports.texts_of([(1100000000 + k, k) for k in range(3)] + [(1, 1)], posts(spark, folder)).select("place", "channel_id", "msg_id", "text")


def deferred_chats(spark: SparkSession, folder: str) -> DataFrame:
    return reports.deferred_chats(channels(spark, folder))


def stored_totals(spark: SparkSession, folder: str) -> DataFrame:
    return reports.totals(raw(spark, folder), posts(spark, folder), payload.observations(raw(spark, folder)))


def live_posts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reports.live_posts(posts(spark, folder), at("2026-07-01 00:00:00"), 30 * 1440).where("age >= 0"), 3)


def metadata_age(spark: SparkSession, folder: str) -> DataFrame:
    return reports.metadata_age(table(spark, folder, "raw_channels").select(F.col("channel_id").alias("tg_id"), "fetched_at"), at()).withColumn("age_s", F.floor("age_s").cast("bigint"))


# ---------------------------------------------------------------- sheets


def family_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Families as a partition of the channels."""
    return cascades.family_or_self(channels(spark, folder).select(F.col("tg_id").alias("node")), family(spark, folder), "node", "community")


def cluster_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Families as clusters, with the medians of the stored scorecard and the members of most posts."""
    card = table(spark, folder, "channel_scorecard")
    measures = card.groupBy(F.col("tg_id").alias("node")).agg(F.max("out_variety").alias("variety"))
    weights = card.groupBy(F.col("tg_id").alias("node")).agg(F.max("posts").cast("double").alias("weight"))
    sheet = reports.cluster_sheet(family_labels(spark, folder), channels(spark, folder), weights, measures, 3)
    return rounded(sheet.where("size > 1"))


def channel_sheet(spark: SparkSession, folder: str) -> DataFrame:
    sheet = reports.channel_sheet(family_labels(spark, folder), channels(spark, folder), family(spark, folder), domain.decayed(spark, folder))
    return rounded(sheet.where("partners > 0").select("node", "username", "family_key", "community", "partners", "link_weight", "inside_share"), 5)


def cited_sheet(spark: SparkSession, folder: str) -> DataFrame:
    found = cascades.cited(domain.reposts(spark, folder), 1).select("channel_id", "msg_id", "families", "sources")
    return rankings.cited_sheet(found, channels(spark, folder), posts(spark, folder)).select("channel_id", "msg_id", "families", "sources", "username", "parts", "views", "reactions", "comments", "forwards", "link", F.length("text").cast("bigint").alias("chars"))


def anomalous(z: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(rankings.pick(domain.anomaly_scores(spark, folder), z, domain.ANOMALY).select("channel_id", "msg_id", "rank", z), 5)

    return query


def directed_weights(spark: SparkSession, folder: str) -> DataFrame:
    nodes, pairs = communities.graph_export(domain.decayed(spark, folder), channels(spark, folder))
    return rounded(pairs.select("src", "dst", "weight", "n"), 5)


# ---------------------------------------------------------------- text forms


def spellings() -> Column:
    """Links and names made of a channel's username and id, a form for each remainder."""
    name, number = F.coalesce("username", F.lit("nobody")), F.col("tg_id").cast("string")
    forms = [
        F.concat(F.lit("https://t.me/"), name), F.concat(F.lit("T.me/"), name, F.lit("/12?single")), F.concat(F.lit("http://www.telegram.me/s/"), name, F.lit("/3")), F.concat(F.lit("t.me/c/"), number, F.lit("/7")),
        F.lit("https://t.me/+AbCdEf"), F.lit("https://t.me/joinchat/AbC"), F.concat(F.lit("https://example.org/"), name), F.concat(F.lit("@"), name), F.concat(F.lit("  "), F.upper(name)), F.concat(F.lit("# "), name), F.lit("no name"),
    ]
    return F.element_at(F.array(*forms), (F.pmod("tg_id", F.lit(len(forms))) + 1).cast("int"))


def link_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = channels(spark, folder).select("tg_id", text.parse_link(spellings()).alias("r")).where("r is not null")
    return rows.select("tg_id", "r.username", "r.channel_id", "r.msg_id")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """What an operator may type, read as usernames; what is none stays null."""
    return channels(spark, folder).select("tg_id", text.valid_entry(spellings()).alias("username"))


def description_handles(spark: SparkSession, folder: str) -> DataFrame:
    """Handles that signing descriptions name."""
    return domain.signing(spark, folder).select("channel_id", F.explode(text.handles("about")).alias("handle"))


def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    return posts(spark, folder).where("text <> ''").select("channel_id", "msg_id", text.excerpt("text", 70).alias("excerpt"))


def post_links(spark: SparkSession, folder: str) -> DataFrame:
    names = channels(spark, folder).select(F.col("tg_id").alias("channel_id"), "username")
    return posts(spark, folder).join(names, "channel_id").select("channel_id", "msg_id", text.post_link("username", "msg_id").alias("link"))


def dialogs(spark: SparkSession, folder: str) -> DataFrame:
    """The inventory as an exported dialog list: what of it is public."""
    rows = channels(spark, folder).select(F.element_at(F.array(*[F.lit(t) for t in ("channel", "megagroup", "group", "user")]), (F.pmod("tg_id", F.lit(4)) + 1).cast("int")).alias("type"), F.col("tg_id").alias("id"), "username", "title")
    return store.public_dialogs(rows).select("tg_id", "username", "is_chat")


def resolve_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The head of the queue of unknown names."""
    return domain.pending_mentions(spark, folder).limit(10).select("username", "sources")


def completed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The newest completed run of the candidates, by its last decision."""
    runs = table(spark, folder, "affiliation_candidates").groupBy(F.col("run_id").alias("id")).agg(F.max(F.when(F.pmod("run_id", F.lit(3)) != 0, F.col("detected_at"))).cast("timestamp").alias("completed_at"))
    return store.completed_run(runs).select("id", epoch("completed_at"))


def classified_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a failure is final, by the name of its class."""
    names = ("ChannelPrivateError", "PeerIdInvalidError", "InviteHashExpiredError", "ValueError", "ChannelBannedError", "TimeoutError", "ChannelPublicGroupNaError")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod("tg_id", F.lit(len(names))) + 1).cast("int"))
    return channels(spark, folder).select(name.alias("error")).groupBy("error").agg(F.count("*").alias("n")).select("error", "n", queues.classify_failure(F.col("error")).alias("failure_kind"))


QUERIES = {
    f.__name__: f
    for f in (
        volume_shares, collected_spans, watched_spans, incoming_section, outgoing_section, travelled_section, affiliated_section, count_families, seed_families, listed_candidates, open_candidates, evidence_lines, handle_blocks,
        alert_evidence, clustered_scorecard, stated_texts, deferred_chats, stored_totals, live_posts, metadata_age, cluster_sheet, channel_sheet, cited_sheet, directed_weights, link_targets, entries, description_handles,
        excerpts, post_links, dialogs, resolve_queue, completed_runs, classified_errors,
    )
} | {f"anomalous_{name}": anomalous(z) for name, z in (("views", "views_z"), ("reactions", "reaction_z"), ("comments", "comment_z"))}

FAMILIES = f"{PAIRS}, {INVENTORY}, {EDGES}, ff as (select e.*, coalesce(sf.family_key, e.src) sfam, coalesce(df.family_key, e.dst) dfam from e left join fresh sf on sf.channel_id = e.src left join fresh df on df.channel_id = e.dst)"
BARE_A = "case when channel_a < -1000000000000 then -channel_a - 1000000000000 else channel_a end"
LAST = f"""cand as (select * from (select least(x, y) channel_a, greatest(x, y) channel_b, * exclude (channel_a, channel_b, x, y, decision, d), d decision, row_number() over (partition by least(x, y), greatest(x, y) order by run_id desc nulls last, d desc nulls last, score desc nulls last,
  about_direction desc nulls last, shared_token desc nulls last, shared_token_channels desc nulls last, handle_token desc nulls last, handle_token_channels desc nulls last, out_share desc nulls last, out_share_edges desc nulls last, edges_a_to_b desc nulls last, edges_b_to_a desc nulls last) rn
  from (select *, {BARE_A} x, {BARE_A.replace("channel_a", "channel_b")} y, lower(trim(decision)) d from affiliation_candidates) where x <> y) where rn = 1)"""
SPELT = """spelt as (select tg_id, regexp_replace(lower(trim(coalesce(username, 'nobody'))), '^@', '') u, tg_id % 11 f, coalesce(username, '') like '@%' at_form from inv)"""
LABELS = f"{PAIRS}, {INVENTORY}, lab as (select tg_id node, coalesce(family_key, tg_id) community from inv left join fresh on channel_id = tg_id)"


def picked(z: str) -> str:
    return f"with recursive {ANOMALY} select channel_id, msg_id, rank::int rank, round({z}, 5) {z} from (select *, row_number() over (partition by channel_id order by {z} desc, msg_id) rank from zs where {z} >= 2.0) where rank <= 3"


ORACLES = {
    "volume_shares": f"with {POSTS}, {INVENTORY} select channel_id, count(*)::bigint posts, round(avg(coalesce(is_forward, false)::int), 6) fwd_share, round(avg((coalesce(body, '') <> '')::int), 6) text_share from posts where channel_id in (select tg_id from inv where status = 'seed' and not is_chat) group by 1",
    "collected_spans": f"with {POSTS} select channel_id, count(*)::bigint posts, epoch(min(published))::bigint first_at, epoch(max(published))::bigint last_at from posts group by 1",
    "watched_spans": "select channel_id, count(*)::bigint readings, count(distinct msg_id)::bigint posts, (epoch_us(min(f)) // 1000000)::bigint first_at, (epoch_us(max(f)) // 1000000)::bigint last_at from (select distinct channel_id, msg_id, fetched_at f, j->>'date' d, j->>'grouped_id' g, (j->>'views')::bigint v, (j->>'forwards')::bigint w, case when json_type(j->'reactions'->'results') = 'ARRAY' then coalesce(list_sum(json_extract(j, '$.reactions.results[*].count')::bigint[]), 0)::bigint end r, (j->'replies'->>'replies')::bigint c from (select *, payload::json j from raw_messages) where j->>'_' = 'Message') group by 1",
    "incoming_section": f"with recursive {FAMILIES} select dst dst_channel_id, title, username, count(*) filter (ff.kind = 'forward')::bigint forwards, count(*) filter (ff.kind = 'mention')::bigint mentions, (epoch_us(max(published_at)) // 1000000)::bigint last_at from ff join inv on tg_id = src where sfam <> dfam and status = 'seed' group by 1, 2, 3",
    "outgoing_section": f"with recursive {FAMILIES} select src src_channel_id, kind, count(*)::bigint refs, count(distinct dst)::bigint targets from ff where sfam <> dfam group by 1, 2",
    "travelled_section": f"with recursive {FAMILIES} select dst dst_channel_id, dst_msg_id, (epoch_us(min(dst_published_at)) // 1000000)::bigint published_at, count(distinct sfam)::bigint families, count(distinct src)::bigint sources from ff join inv on tg_id = src where sfam <> dfam and ff.kind = 'forward' and dst_msg_id is not null and status = 'seed' group by 1, 2",
    "affiliated_section": f"with recursive {PAIRS}, {INVENTORY}, {POSTS}, n as (select channel_id, count(*)::bigint posts from posts group by 1) select f.channel_id, family_key, title, username, is_chat, coalesce(n.posts, 0)::bigint posts from fresh f join inv on tg_id = f.channel_id left join n on n.channel_id = f.channel_id",
    "count_families": f"with recursive {PAIRS} select count(distinct family_key)::bigint families, count(*)::bigint channels from fresh",
    "seed_families": f"with recursive {PAIRS}, {INVENTORY} select tg_id, coalesce(family_key, tg_id) family_key from inv left join fresh on channel_id = tg_id where status = 'seed'",
    "listed_candidates": f"with {LAST}, {INVENTORY} select channel_a, channel_b, round(score, 9) score, decision, a.username username_a, b.username username_b, a.status status_a, b.status status_b from cand join inv a on a.tg_id = channel_a join inv b on b.tg_id = channel_b",
    "open_candidates": f"with {LAST}, {INVENTORY} select channel_a, channel_b, round(score, 9) score from cand join inv a on a.tg_id = channel_a join inv b on b.tg_id = channel_b where decision = 'pending' and (a.status = 'seed' or b.status = 'seed') order by cand.score desc nulls last, channel_a, channel_b limit 20",
    "evidence_lines": f"""with {LAST} select channel_a, channel_b, concat_ws('; ', 'description ' || about_direction, 'handle ' || handle_token || ' in ' || handle_token_channels, 'share ' || format('{{:.2f}}', out_share) || ' of ' || out_share_edges,
  'token ' || shared_token || ' in ' || shared_token_channels, 'mutual ' || edges_a_to_b || '/' || edges_b_to_a) line from cand""",
    "handle_blocks": f"with {LAST}, h as (select handle_token, channel_a, channel_b from cand where handle_token is not null) select handle_token, (select count(*) from h x where x.handle_token = t.handle_token)::bigint pairs, count(distinct c)::bigint channels from (select handle_token, channel_a c from h union all select handle_token, channel_b from h) t group by 1",
    "alert_evidence": f"""with recursive {REPOSTS}, {INVENTORY}, al as (select channel_id, msg_id from rp where src_family <> dst_family and published_at >= dst_published_at and epoch_us(published_at) - epoch_us(dst_published_at) <= 240 * 3600 * 1000000::bigint group by 1, 2),
held as (select al.channel_id, al.msg_id, title, username, published, body from al join posts p on p.channel_id = al.channel_id and p.msg_id = al.msg_id join inv on tg_id = al.channel_id),
carried as (select distinct h.channel_id, h.msg_id, c.title, c.username cu from held h join e on e.dst = h.channel_id and e.dst_msg_id = h.msg_id and e.kind = 'forward' join inv c on c.tg_id = e.src where epoch_us(e.published_at) <= epoch_us(h.published) + 240 * 3600 * 1000000::bigint)
select h.channel_id, h.msg_id, h.username, epoch(published)::bigint published, length(body)::bigint chars, cu carrier_username from held h left join carried k on k.channel_id = h.channel_id and k.msg_id = h.msg_id""",
    "clustered_scorecard": f"with {INVENTORY}, c as (select username, min(coalesce(list_position({KINDS}, kind), case when kind is not null then 0 end)) k from inv where tg_id % 2 = 0 and username is not null group by 1) select tg_id, s.username, k::bigint cluster from channel_scorecard s left join c on c.username = s.username",
    "stated_texts": f"with {POSTS}, w as (select unnest([0, 1, 2, 3]) place, unnest([1100000000, 1100000001, 1100000002, 1])::bigint channel_id, unnest([0, 1, 2, 1])::bigint msg_id) select place::int place, w.channel_id, w.msg_id, body \"text\" from w left join posts p on p.channel_id = w.channel_id and p.msg_id = w.msg_id",
    "deferred_chats": f"with {INVENTORY} select count(*)::bigint deferred from inv where status = 'seed' and is_chat and linked_to is null",
    "stored_totals": f"with {POSTS} select (select count(*) from raw_messages)::bigint messages, (select count(*) from posts)::bigint posts, (select count(*) from (select distinct channel_id, msg_id, fetched_at, j->>'date', j->>'grouped_id', (j->>'views')::bigint, (j->>'forwards')::bigint, case when json_type(j->'reactions'->'results') = 'ARRAY' then coalesce(list_sum(json_extract(j, '$.reactions.results[*].count')::bigint[]), 0)::bigint end, (j->'replies'->>'replies')::bigint from (select *, payload::json j from raw_messages) where j->>'_' = 'Message'))::bigint snapshots",
    "live_posts": f"with {POSTS}, a as (select channel_id, msg_id, (epoch_us(timestamp '2026-07-01 00:00:00') - epoch_us(published)) / 60e6 age from posts) select channel_id, msg_id, round(age, 3) age from a where age between 0 and 30 * 1440",
    "metadata_age": f"select channel_id tg_id, floor((epoch_us({NOW}) - epoch_us(max(fetched_at))) / 1e6)::bigint age_s from raw_channels where channel_id is not null group by 1",
    "cluster_sheet": f"""with recursive {LABELS}, card as (select tg_id, max(out_variety) variety, max(posts)::double w from channel_scorecard group by 1),
r as (select community, node, coalesce(title, username, node::varchar) nm, kind, variety, w from lab join inv on inv.tg_id = node left join card on card.tg_id = node), k as (select community, kind, count(*) n from r where kind is not null group by 1, 2),
tk as (select community, arg_max(kind, (n, kind)) top_kind, max(n)::bigint top_kind_n from k group by 1), m as (select community, string_agg(nm, ' · ' order by p) members from (select *, row_number() over (partition by community order by coalesce(w, 0) desc, node) p from r) where p <= 3 group by 1)
select s.community, s.size, round(mv, 6) median_variety, top_kind, top_kind_n, members from (select community, count(*)::bigint size, median(variety) mv from r group by 1) s left join tk using (community) left join m using (community) where size > 1""",
    "channel_sheet": f"""with recursive {LABELS}, {DECAYED}, w as (select * from d where src <> dst), n as (select src node, dst other, weight from w union all select dst, src, weight from w),
l as (select n.node, count(distinct other)::bigint partners, sum(weight) lw, sum(case when a.community = b.community then weight else 0 end) / sum(weight) ins from n left join lab a on a.node = n.node left join lab b on b.node = n.other group by 1)
select lab.node, username, community family_key, community, partners, round(lw, 5) link_weight, round(ins, 5) inside_share from lab join inv on tg_id = lab.node join l on l.node = lab.node""",
    "cited_sheet": f"""with recursive {REPOSTS}, {INVENTORY}, c as (select channel_id, msg_id, count(distinct src_family)::bigint families, count(distinct src)::bigint sources from rp where src_family <> dst_family group by 1, 2 having count(distinct src_family) > 1),
w as (select channel_id, min(msg_id) msg_id, count(*)::bigint parts, max(views) views, max(reactions) reactions, max(comments) comments, max(forwards) forwards, arg_max(coalesce(body, '~none'), (length(coalesce(body, '')), msg_id)) body from posts group by channel_id, coalesce(grouped_id, -msg_id))
select c.channel_id, c.msg_id, families, sources, username, parts, views, reactions, comments, forwards, 'https://t.me/' || username || '/' || c.msg_id link, length(trim(regexp_replace(nullif(body, '~none'), '\\s+', ' ', 'g')))::bigint chars
from c join inv on tg_id = c.channel_id left join w on w.channel_id = c.channel_id and w.msg_id = c.msg_id""",
    "directed_weights": f"with {INVENTORY}, {DECAYED} select src, dst, round(sum(weight), 5) weight, sum(n)::bigint n from d group by 1, 2",
    "link_targets": f"""with {INVENTORY}, {SPELT}, r as (select tg_id, case when f in (0, 1, 2) then lower(u) end username, case when f = 3 then tg_id end channel_id, case when f = 1 then 12 when f = 3 then 7 end::bigint msg_id from spelt where f in (0, 1, 2, 3))
select * from r where channel_id is not null or regexp_full_match(username, '[a-z][a-z0-9_]{{3,31}}')""",
    "entries": f"with {INVENTORY}, {SPELT} select tg_id, case when f in (0, 1, 2, 7, 8) and not (f = 7 and at_form) and regexp_full_match(lower(u), '[a-z][a-z0-9_]{{3,31}}') then lower(u) end username from spelt",
    "description_handles": f"with {INVENTORY}, {ABOUT}, s as (select tg_id channel_id, case when tg_id % 2 = 0 then coalesce(about, '') || ' @' || coalesce(list_filter(string_split(replace(lower(username), '-', '_'), '_'), lambda x: length(x) >= 4)[1], '?') else about end t from inv left join ab on channel_id = tg_id where username is not null) select channel_id, unnest(list_distinct(list_transform(regexp_extract_all(t, '@([A-Za-z0-9][A-Za-z0-9_]{{3,31}})', 1), lambda x: lower(x)))) handle from s",
    "excerpts": f"with {POSTS}, o as (select channel_id, msg_id, trim(regexp_replace(body, '\\s+', ' ', 'g')) t from posts where body <> '') select channel_id, msg_id, case when length(t) > 70 then rtrim(substr(t, 1, 70)) || '…' else t end excerpt from o",
    "post_links": f"with {POSTS}, {INVENTORY} select channel_id, msg_id, 'https://t.me/' || username || '/' || msg_id link from posts join inv on tg_id = channel_id",
    "dialogs": f"with {INVENTORY} select tg_id, username, tg_id % 4 = 1 is_chat from inv where tg_id % 4 in (0, 1) and username is not null",
    "completed_runs": "select run_id id, (epoch_us(max(detected_at)) // 1000000)::bigint completed_at from affiliation_candidates where run_id % 3 <> 0 group by 1 having max(detected_at) is not null order by max(detected_at) desc, run_id desc limit 1",
    "classified_errors": f"""with {INVENTORY}, x as (select ['ChannelPrivateError', 'PeerIdInvalidError', 'InviteHashExpiredError', 'ValueError', 'ChannelBannedError', 'TimeoutError', 'ChannelPublicGroupNaError'][tg_id % 7 + 1] error from inv)
select error, count(*)::bigint n, case when error in ('ChannelBannedError', 'TimeoutError') then 'transient' else 'permanent' end failure_kind from x group by 1""",
    "anomalous_views": picked("views_z"), "anomalous_reactions": picked("reaction_z"), "anomalous_comments": picked("comment_z"),
}
from tidewire.plans.domain_sql import ORACLES as DOMAIN  # noqa: E402

ORACLES["resolve_queue"] = f"select username, sources from ({DOMAIN['pending_mentions']}) order by sources desc, username limit 10"
