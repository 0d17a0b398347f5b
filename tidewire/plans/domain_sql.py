"""Oracle SQL of the domain queries."""

from __future__ import annotations

from tidewire.plans.problems import BARE, PAIRS

KINDS = "['personal', 'company', 'vacancies', 'aggregator', 'community', 'media', 'event']"
STATUSES = "['candidate', 'seed', 'maybe', 'rejected']"
NOW = "timestamp '2026-08-01 00:00:00'"

INVENTORY = f"""inv as (
  select tg_id, username, title, is_chat, status, kind, resolved_at, resolve_attempts, linked_to from (
    select *, row_number() over (partition by tg_id order by first_seen_at nulls first, coalesce(username, '~'), status nulls first, kind nulls first, title nulls first, is_chat nulls first,
      username nulls first, linked_to nulls first, discovered_via nulls first, resolved_at nulls first, resolve_attempts nulls first, reject_reason nulls first) rn
    from (select {BARE.format("tg_id")} tg_id, * exclude (tg_id) from channels)) where rn = 1)"""

NAMES = "names as (select lower(username) uname, max(tg_id) dst from inv where username is not null group by 1)"

FIRST = """firsts as (
  select channel_id, msg_id, payload::json j from (
    select *, row_number() over (partition by channel_id, msg_id order by fetched_at nulls first, payload nulls first) rn from raw_messages) where rn = 1)"""

POSTS = """posts as (
  select channel_id, msg_id, fetched_at, (j->>'date')::timestamptz published, j->>'message' body, (j->>'grouped_id')::bigint grouped_id, (j->>'views')::bigint views, (j->>'forwards')::bigint forwards,
    case when json_type(j->'reactions'->'results') = 'ARRAY' then coalesce(list_sum(json_extract(j, '$.reactions.results[*].count')::bigint[]), 0)::bigint end reactions,
    (j->'replies'->>'replies')::bigint comments, (j->'fwd_from'->'from_id'->>'channel_id')::bigint reposted_from, json_type(j->'fwd_from') = 'OBJECT' is_forward, j
  from (select channel_id, msg_id, fetched_at, payload::json j from (
    select *, row_number() over (partition by channel_id, msg_id order by fetched_at desc nulls last, payload desc nulls last) rn from raw_messages) where rn = 1)
  where j->>'_' = 'Message')"""

EDGES = f"""e as (
  select src, msg_id, kind, dst, dst_msg_id, min(published_at) published_at, min(dst_published_at) dst_published_at, min(derived_at) derived_at
  from (select *, {BARE.format("src_channel_id")} src, {BARE.format("dst_channel_id")} dst from edges) group by all)"""

MESSAGES = f"""{INVENTORY}, {NAMES}, {FIRST},
msgs as (select channel_id, msg_id, j, (j->>'date')::timestamptz published_at from firsts
  where channel_id in (select tg_id from inv where status in ('candidate', 'seed', 'maybe') and not is_chat) and (j->>'date') is not null),
fwd as (select channel_id src, msg_id, 'forward' kind, (j->'fwd_from'->'from_id'->>'channel_id')::bigint dst, (j->'fwd_from'->>'channel_post')::bigint dst_msg_id, published_at,
    (j->'fwd_from'->>'date')::timestamptz dst_published_at, (j->>'grouped_id')::bigint grouped_id
  from msgs where (j->'fwd_from'->'from_id'->>'_') = 'PeerChannel' and (j->'fwd_from'->'from_id'->>'channel_id') is not null and (j->'fwd_from'->'from_id'->>'channel_id')::bigint <> channel_id),
ents as (select channel_id, msg_id, published_at, (j->>'grouped_id')::bigint grouped_id, j->>'message' body, unnest(json_extract(j, '$.entities[*]')) ent from msgs),
spots as (select *, (ent->>'length')::int len, list_filter(range(0, length(body) + 1), lambda k: k + length(regexp_replace(substr(body, 1, k), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) = (ent->>'offset')::int)[1] k
  from ents where ent->>'_' = 'MessageEntityMention'),
refs as (select channel_id src, msg_id, published_at, grouped_id, uname from (
  select *, regexp_replace(lower(trim(substr(body, k + 1, len))), '^@', '') uname from spots) where regexp_full_match(uname, '[a-z][a-z0-9_]{{3,31}}')),
resolved as (select r.*, n.dst from refs r left join names n using (uname)),
every as (select * from fwd union all select src, msg_id, 'mention', dst, null, published_at, null, grouped_id from resolved where dst is not null and dst <> src)"""

REPOSTS = f"""{PAIRS}, {POSTS}, {EDGES},
parts as (select channel_id, msg_id, min(msg_id) over (partition by channel_id, grouped_id) first_part from posts where grouped_id is not null),
rp as (select e.dst channel_id, coalesce(p.first_part, e.dst_msg_id) msg_id, e.src, coalesce(sf.family_key, e.src) src_family, coalesce(df.family_key, e.dst) dst_family, e.dst_published_at, e.published_at
  from e left join parts p on p.channel_id = e.dst and p.msg_id = e.dst_msg_id left join fresh sf on sf.channel_id = e.src left join fresh df on df.channel_id = e.dst
  where e.kind = 'forward' and e.dst_msg_id is not null)"""

SINCE = "timestamp '2025-06-01 00:00:00'"

READINGS = f"""{INVENTORY},
obs as (select distinct channel_id, msg_id, fetched_at observed_at, (j->>'date')::timestamptz published_at, (j->>'grouped_id')::bigint album, (j->>'views')::bigint views, (j->>'forwards')::bigint forwards,
    case when json_type(j->'reactions'->'results') = 'ARRAY' then coalesce(list_sum(json_extract(j, '$.reactions.results[*].count')::bigint[]), 0)::bigint end reactions, (j->'replies'->>'replies')::bigint comments
  from (select *, payload::json j from raw_messages) where j->>'_' = 'Message'),
wide as (select o.*, inv.kind, inv.status = 'seed' and not inv.is_chat seed, inv.tg_id % 7 <> 0 healthy, (epoch_us(observed_at) / 1e6 - epoch_us(published_at) / 1e6) / 60 age from obs o join inv on inv.tg_id = o.channel_id),
rd as (select channel_id, msg_id, album, kind, seed, healthy, observed_at, published_at, age, metric, val::double val, case when age < 2880 then '0m' when age < 5760 then '2880m' when age < 11520 then '5760m' when age < 57600 then '11520m' end band
  from (unpivot wide on views, reactions, forwards, comments into name metric value val) where age >= 0),
med as (select channel_id, metric, median(val) median, count(*)::bigint samples from rd where seed and healthy and age >= 4320 and age < 43200 and val > 0 group by all having count(*) >= 8),
fitted as (select * from rd where kind is not null and val > 0 and published_at >= {SINCE}),
ref as (select channel_id, msg_id, metric, max(val) reference from fitted where band = '5760m' group by all),
pool as (select * from fitted union all select * replace ('*' as kind) from fitted),
curve as (select kind, metric, band, median(val / reference) fraction, count(*)::bigint samples from pool join ref using (channel_id, msg_id, metric) where band is not null group by all having count(*) >= 3),
refpool as (select ref.*, k.kind from ref join (select distinct channel_id, kind from fitted union all select distinct channel_id, '*' from fitted) k using (channel_id)),
factor as (select kind, metric, median(reference / median) factor from refpool join med using (channel_id, metric) where median > 0 group by all having count(*) >= 3),
resid as (select kind, metric, band, ln(val / (median * factor * fraction)) r from pool join med using (channel_id, metric) join curve using (kind, metric, band) join factor using (kind, metric) where median * factor * fraction > 0),
ps as (select kind, metric, 1.4826 * mad(r) sp from resid group by all having count(*) >= 3 and mad(r) > 0),
bs as (select kind, metric, band, 1.4826 * mad(r) sb from resid group by all having count(*) >= 3 and mad(r) > 0),
own as (select kind, metric, band, fraction, factor, coalesce(sb, sp) spread from curve join factor using (kind, metric) join ps using (kind, metric) left join bs using (kind, metric, band)),
fit as (select *, false borrowed from own where kind <> '*' union all
  select w.kind, own.metric, own.band, own.fraction, own.factor, own.spread, true from (select distinct kind, metric from fitted) w join own on own.kind = '*' and own.metric = w.metric
  where not exists (select 1 from own o where o.kind = w.kind and o.metric = w.metric))"""


def scores(now: str, name: str = "sc") -> str:
    """Scores at a moment: of seeds, of posts in the window, of the first part of an album among the readings that are seen."""
    return f"""{name}_win as (select * from rd where seed and published_at >= {SINCE} and published_at <= {now} and observed_at <= {now}),
{name}_post as (select w.* from {name}_win w left join (select channel_id, album, min(msg_id) head from {name}_win where album is not null group by all) f on f.channel_id = w.channel_id and f.album = w.album where w.album is null or w.msg_id = f.head),
{name} as (select channel_id, msg_id, observed_at, metric, age, val, median * factor * fraction expected, ln(greatest(val, 0.5) / (median * factor * fraction)) / spread z
  from {name}_post join fit using (kind, metric, band) join med using (channel_id, metric) where metric in ('views', 'reactions', 'forwards') and spread > 0 and median * factor * fraction > 0),
{name}_best as (select *, row_number() over (partition by channel_id, msg_id order by z desc, case metric when 'views' then 0 when 'reactions' then 1 when 'forwards' then 2 else 3 end, age) rn from {name}),
{name}_spike as (select * from {name}_best where rn = 1 and z >= 1.5)"""


REPLAYED = "timestamp '2026-01-01 00:00:00'"


def spikes(now: str) -> str:
    return f"with {READINGS}, {scores(now)} select channel_id, msg_id, metric, round(z, 5) z, round(val / expected, 5) times from sc_spike"


OUTWARD = f"""{PAIRS}, {EDGES},
outs as (select e.src, e.dst from e left join fresh sf on sf.channel_id = e.src left join fresh df on df.channel_id = e.dst where coalesce(sf.family_key, e.src) <> coalesce(df.family_key, e.dst)),
oc as (select src, dst, count(*) n from outs group by all),
bits as (select src channel_id, -sum(n / t * log2(n / t)) out_variety, count(*)::bigint out_targets from (select *, sum(n) over (partition by src) t from oc) group by 1),
ins as (select dst channel_id, count(*)::bigint in_sources from oc group by 1),
rec as (select a.src channel_id, count(b.src) / count(*) reciprocity from oc a left join oc b on b.src = a.dst and b.dst = a.src where a.dst in (select channel_id from collected) group by 1),
variety as (select coalesce(bits.channel_id, ins.channel_id) channel_id, out_variety, coalesce(out_targets, 0) out_targets, coalesce(in_sources, 0) in_sources, reciprocity
  from bits left join rec on rec.channel_id = bits.channel_id full join ins on ins.channel_id = bits.channel_id)"""

MEDIANS = """pm as (select channel_id, count(*)::bigint posts, median(views) median_views, median(coalesce(reactions, 0)) median_reactions, median(forwards) median_forwards,
  case when count(*) >= 10 then median(coalesce(reactions, 0) / views) filter (views > 0) end reaction_rate, case when count(*) >= 10 then median(forwards / views) filter (views > 0) end forward_rate,
  case when count(*) >= 10 then median(comments / views) filter (views > 0) end comment_rate from posts group by 1)"""

ABOUT = """ab as (select channel_id, j->'full_chat'->>'about' about, (j->'full_chat'->>'participants_count')::bigint subscribers from (
  select *, row_number() over (partition by channel_id order by fetched_at desc, j->'full_chat'->>'about' desc nulls last, (j->'full_chat'->>'participants_count')::bigint desc nulls last) rn
  from (select channel_id, fetched_at, case when json_valid(payload) then payload::json end j from raw_channels) where (j->'full_chat'->>'id')::bigint = channel_id) where rn = 1)"""

NAMED = "atnames as (select channel_id, unnest(list_distinct(list_transform(regexp_extract_all(about, '@([A-Za-z][A-Za-z0-9_]{3,31})', 1), lambda x: lower(x)))) username from ab)"

TOKENS = """tok as (select distinct tg_id, t from (select tg_id, unnest(string_split(replace(lower(username), '-', '_'), '_')) t from inv where username is not null) where length(t) >= 4)"""

STYLE = """own as (select *, json_extract(j, '$.entities[*]') ents from posts where not coalesce(is_forward, false) and body <> ''),
counted as (select channel_id, length(body) chars, greatest(len(regexp_extract_all(body, '[.!?…\\n]+')), 1) sentences, len(regexp_extract_all(body, '[A-Za-z]')) latin, len(regexp_extract_all(body, '[А-Яа-яЁё]')) cyrillic,
  len(regexp_extract_all(body, '[!?]')) emphatic, len(regexp_extract_all(body, '[\\x{1F300}-\\x{1FAFF}☀-➿]')) + len(list_filter(ents, lambda e: e->>'_' = 'MessageEntityCustomEmoji')) emoji,
  len(list_filter(ents, lambda e: e->>'_' in ('MessageEntityCode', 'MessageEntityPre'))) code, len(list_filter(ents, lambda e: e->>'_' in ('MessageEntityUrl', 'MessageEntityTextUrl'))) links,
  coalesce(list_sum(list_transform(list_filter(ents, lambda e: e->>'_' = 'MessageEntityBlockquote'), lambda e: (e->>'length')::int)), 0) quoted from own),
ms as (select channel_id, count(*)::bigint text_posts, median(chars) median_len, quantile_cont(chars, 0.9) p90_len, median(chars / sentences) sentence_len, least(sum(quoted) / nullif(sum(chars), 0), 1.0) quote_share,
  avg((code > 0)::int) code_share, sum(latin) / nullif(sum(latin + cyrillic), 0) latin_share, 1000 * sum(links) / nullif(sum(chars), 0) link_density, 1000 * sum(emoji) / nullif(sum(chars), 0) emoji_density,
  1000 * sum(emphatic) / nullif(sum(chars), 0) emphatic_density from counted group by 1)"""


def z(column: str, transform: str) -> str:
    value = {"log": f"ln(1 + {column})", "sqrt": f"sqrt({column})"}[transform]
    centre, width = f"(select median({value}) from big)", f"(select 1.4826 * mad({value}) from big)"
    return f"(case when {width} > 0 and {value} is not null then greatest(-4, least(4, ({value} - {centre}) / {width})) end)"


ANOMALY = f"""{PAIRS}, {POSTS},
alien as (select p.* from posts p left join fresh o on o.channel_id = p.channel_id left join fresh s on s.channel_id = p.reposted_from
  where coalesce(s.family_key, p.reposted_from) is distinct from coalesce(o.family_key, p.channel_id)),
whole as (select channel_id, coalesce(grouped_id, -msg_id) album, min(msg_id) msg_id, max(views)::double views, max(forwards)::double forwards, max(reactions)::double reactions, max(comments)::double comments from alien group by 1, 2),
seen as (select *, count(*) over c channel_posts, count(reactions) over c rn, count(comments) over c cn from whole where views > 0 window c as (partition by channel_id)),
kept as (select channel_id, msg_id, views, forwards, case when rn > 0 then coalesce(reactions, 0) end reactions, case when cn > 0 then coalesce(comments, 0) end comments, ln(views) lv from seen where channel_posts >= 10),
base as (select channel_id, case when median(reactions) > 0 then sum(reactions) / sum(views) filter (reactions is not null) end br, case when median(forwards) > 0 then sum(forwards) / sum(views) filter (forwards is not null) end bf,
  case when median(comments) > 0 then sum(comments) / sum(views) filter (comments is not null) end bc from kept group by 1),
logs as (select k.*, ln(case when reactions + 1000 * br > 0 then (reactions + 1000 * br) / (views + 1000) end) lr, ln(case when forwards + 1000 * bf > 0 then (forwards + 1000 * bf) / (views + 1000) end) lf, ln(case when comments + 1000 * bc > 0 then (comments + 1000 * bc) / (views + 1000) end) lc from kept k join base using (channel_id)),
st as (select channel_id, {", ".join(f"median({c}) m{c}, greatest(1.4826 * mad({c}), quantile_cont({c}, 0.84) - median({c})) s{c}" for c in ("lv", "lr", "lf", "lc"))} from logs group by 1),
zs as (select l.channel_id, l.msg_id, views / exp(mlv) views_lift, (lv - mlv) / nullif(slv, 0) views_z, case when reactions >= 10 then (lr - mlr) / nullif(slr, 0) end reaction_z,
  case when forwards >= 10 then (lf - mlf) / nullif(slf, 0) end forward_z, case when comments >= 10 then (lc - mlc) / nullif(slc, 0) end comment_z from logs l join st using (channel_id))"""

DECAYED = f"{EDGES}, d as (select src, dst, kind, sum(pow(0.5, (epoch({NOW}) - epoch_us(published_at) / 1e6) / 86400 / 180)) weight, count(*)::bigint n from e group by all)"

LABELLED = f"""{INVENTORY}, {DECAYED}, lab as (select tg_id node, coalesce(list_position({KINDS}, kind), 0)::bigint community from inv where kind is not null),
ends2 as (select d.src, d.dst, a.community cs, b.community cd, weight, kind from d join lab a on a.node = d.src join lab b on b.node = d.dst where d.src <> d.dst),
ends as (select src node, cs home, cd other, weight, kind from ends2 union all select dst, cd, cs, weight, kind from ends2)"""

STATE = "state as (select channel_id tg_id, max(fetched_at) due_at from raw_messages group by 1)"
RATES = f"""rates as (select channel_id, count(*) / 30.0 posts_per_day from posts where epoch({NOW}) - epoch_us(published) / 1e6 >= 0 and epoch({NOW}) - epoch_us(published) / 1e6 < 30 * 86400 group by 1)"""
PC = "pc as (select src, dst, count(*)::bigint n from e where kind in ('forward', 'mention') group by all)"

SHARES = """sh as (select least(src, dst) channel_a, greatest(src, dst) channel_b, share, out_edges, src from (
  select src, arg_max(dst, (n, -dst)) dst, max(n) / sum(n) share, sum(n)::bigint out_edges from pc group by src) where src <> dst and out_edges >= 5 and share >= 0.3),
share_signal as (select channel_a, channel_b, share out_share, out_edges out_share_edges, src out_share_src from (select *, row_number() over (partition by channel_a, channel_b order by share desc, out_edges desc, src) rn from sh) where rn = 1)"""
MUTUAL = """mutual as (select a.src channel_a, a.dst channel_b, a.n edges_a_to_b, b.n edges_b_to_a, least(1.0, least(a.n, b.n) / 2.0) strength from pc a join pc b on b.src = a.dst and b.dst = a.src where a.src < a.dst and a.n >= 1 and b.n >= 1)"""


def token_pairs(source: str, name: str, cap: int, order: str) -> str:
    return f"""{name}_n as (select t, count(*) n from {source} group by 1 having count(*) between 2 and {cap}),
{name} as (select channel_a, channel_b, t, n from (select x.tg_id channel_a, y.tg_id channel_b, x.t, c.n, row_number() over (partition by x.tg_id, y.tg_id order by {order}) rn
  from {source} x join {source} y on x.t = y.t and x.tg_id < y.tg_id join {name}_n c on c.t = x.t) where rn = 1)"""


HANDLES = f"""signed as (select distinct t from tok join (select channel_id tg_id, unnest(list_transform(regexp_extract_all(about, '@([A-Za-z0-9][A-Za-z0-9_]{{3,31}})', 1), lambda x: lower(x))) t from ab) h using (tg_id, t)),
stok as (select * from tok where t in (select t from signed)), {token_pairs("stok", "hp", 10, "length(x.t) desc, x.t")}"""
TARGETS = """tg as (select distinct a.channel_id source, n.dst target from atnames a join names n on n.uname = a.username where n.dst <> a.channel_id),
about_signal as (select least(source, target) channel_a, greatest(source, target) channel_b, case when count(*) = 2 then 1.0 else 0.5 end strength,
  case when count(*) = 2 then 'mutual' when max(source < target) then 'a_to_b' else 'b_to_a' end about_direction from tg group by 1, 2)"""

ORACLES = {
    "derived_edges": f"with {MESSAGES} select src src_channel_id, msg_id, kind, dst dst_channel_id, dst_msg_id, epoch(min(published_at))::bigint published_at, epoch(min(dst_published_at))::bigint dst_published_at, min(grouped_id) grouped_id from every group by src, msg_id, kind, dst, dst_msg_id",
    "discovered_channels": f"with {MESSAGES} select distinct dst tg_id, 'forward' discovered_via from fwd where dst not in (select tg_id from inv)",
    "pending_mentions": f"with {MESSAGES} select uname username, count(distinct src)::bigint sources from resolved where dst is null and uname not in (select uname from names) group by 1",
    "missing_edges": f"with {MESSAGES}, {EDGES} select distinct src src_channel_id, msg_id, kind, dst dst_channel_id, dst_msg_id from every x where not exists (select 1 from e where e.src = x.src and e.msg_id = x.msg_id and e.kind = x.kind and e.dst = x.dst and e.dst_msg_id is not distinct from x.dst_msg_id)",
    "edge_keys": f"with {EDGES} select src src_channel_id, msg_id, kind, dst dst_channel_id, dst_msg_id, epoch(published_at)::bigint published_at, epoch(derived_at)::bigint derived_at from e",
    "inventory": f"with {INVENTORY} select tg_id, username, title, status, kind, is_chat from inv",
    "first_wins": "select channel_id, msg_id, fetched_at, size from (select channel_id, msg_id, epoch(fetched_at)::bigint fetched_at, length(payload)::bigint size, row_number() over (partition by channel_id, msg_id order by epoch(fetched_at)::bigint, length(payload)) rn from raw_messages r where not exists (select 1 from cited_posts c where c.channel_id = r.channel_id and c.msg_id = r.msg_id)) where rn = 1",
    "latest_wins": "select channel_id, fetched_at, payload from (select channel_id, epoch(fetched_at)::bigint fetched_at, coalesce(payload, '') payload, row_number() over (partition by channel_id order by epoch(fetched_at)::bigint desc, coalesce(payload, '') desc) rn from raw_channels) where rn = 1",
    "post_counters": f"with {READINGS} select channel_id, msg_id, epoch(observed_at)::bigint observed_at, epoch(published_at)::bigint published_at, views, forwards, reactions, comments from obs",
    "reaction_kinds": """with r as (select channel_id, msg_id, fetched_at, payload, unnest(json_extract(payload::json, '$.reactions.results[*]')) x, row_number() over () id from raw_messages),
k as (select channel_id, msg_id, fetched_at, payload, case x->'reaction'->>'_' when 'ReactionEmoji' then coalesce(x->'reaction'->>'emoticon', 'unknown') when 'ReactionCustomEmoji' then 'custom:' || coalesce(x->'reaction'->>'document_id', 'None') when 'ReactionPaid' then 'paid' else 'unknown' end reaction, (x->>'count')::bigint c from r),
g as (select channel_id, msg_id, fetched_at, payload, reaction, sum(c) n, count(*) copies from k group by all)
select reaction, count(*)::bigint posts, sum(n)::bigint total from g group by 1""",
    "mention_names": f"with {MESSAGES.replace('where channel_id in (select tg_id from inv where status in', 'where true or channel_id in (select tg_id from inv where status in')} select src channel_id, msg_id, uname username, count(*)::bigint n from refs group by all",
    "about_names": f"with {ABOUT}, {NAMED} select channel_id, username from atnames where username not in ('addemoji','addlist','addstickers','addtheme','boost','confirmphone','contact','giftcode','invoice','joinchat','login','proxy','setlanguage','share','socks')",
    "album_parts": f"""with {POSTS} select channel_id, min(msg_id) msg_id, count(*)::bigint parts, max(views) views, max(forwards) forwards, max(reactions) reactions, max(comments) comments, length(arg_max(body, (length(coalesce(body, '')), msg_id)))::bigint chars
from posts where grouped_id is not null group by channel_id, grouped_id having count(*) > 1""",
    "event_props": "select event_type, count(*)::bigint n, count((props::json->>'k')::bigint)::bigint with_k, sum((props::json->>'k')::bigint)::bigint k from events group by 1",
    "pair_counts": f"with {EDGES}, {PC} select * from pc",
    "top_targets": f"with {EDGES}, {PC} select src, arg_max(dst, (n, -dst)) dst, max(n) n, sum(n)::bigint out_edges from pc group by src",
    "share_pairs": f"with {EDGES}, {PC}, {SHARES} select channel_a, channel_b, round(out_share, 9) out_share, out_share_edges, out_share_src from share_signal",
    "mutual_pairs": f"with {EDGES}, {PC}, {MUTUAL} select channel_a, channel_b, round(strength, 9) strength, edges_a_to_b, edges_b_to_a from mutual",
    "shared_tokens": f"with {INVENTORY}, {TOKENS}, {token_pairs('tok', 'tp', 3, 'c.n, length(x.t) desc, x.t')} select channel_a, channel_b, round((4 - n) / 3.0, 9) strength, t shared_token, n::int shared_token_channels from tp",
    "signed_handles": f"with {INVENTORY}, {TOKENS}, {ABOUT.replace('ab as', 'stored as', 1)}, ab as (select tg_id channel_id, case when tg_id % 2 = 0 then coalesce(about, '') || ' @' || coalesce(list_filter(string_split(replace(lower(username), '-', '_'), '_'), lambda x: length(x) >= 4)[1], '?') else about end about from inv left join stored on channel_id = tg_id where username is not null), {HANDLES.replace('between 2 and 10', 'between 2 and 40')} select channel_a, channel_b, 1.0::double strength, t handle_token, n::int handle_token_channels from hp",
    "about_pairs": f"""with {INVENTORY}, {NAMES}, {EDGES}, {PC}, top as (select src, arg_max(dst, (n, -dst)) dst from pc group by src), named as (select src, top.dst, username from top join inv on tg_id = top.dst where username is not null and (src % 3 = 2 or regexp_full_match(username, '[A-Za-z][A-Za-z0-9_]{{3,31}}'))),
tg as (select distinct src source, t target from (select src, case when src % 3 = 2 then named.dst else names.dst end t from named left join names on uname = lower(username)) where t is not null and t <> src), {TARGETS[TARGETS.index("about_signal"):]}
select channel_a, channel_b, strength::double strength, about_direction from about_signal""",
    "detected_pairs": f"""with recursive {PAIRS}, {INVENTORY}, {NAMES}, {TOKENS}, {ABOUT}, {NAMED}, {TARGETS}, {HANDLES}, {EDGES}, {PC}, {SHARES}, {MUTUAL},
tok2 as (select * from tok where t not in (select t from hp)), {token_pairs("tok2", "tp", 3, "c.n, length(x.t) desc, x.t")},
al as (select channel_a, channel_b, strength * 1.0 part, about_direction, null handle_token, null::int handle_token_channels, null::double out_share, null::bigint out_share_edges, null::bigint out_share_src, null shared_token, null::int shared_token_channels, null::bigint edges_a_to_b, null::bigint edges_b_to_a from about_signal
  union all select channel_a, channel_b, 1.0, null, t, n::int, null, null, null, null, null, null, null from hp
  union all select channel_a, channel_b, out_share * 0.8, null, null, null, out_share, out_share_edges, out_share_src, null, null, null, null from share_signal
  union all select channel_a, channel_b, (4 - n) / 3.0 * 0.6, null, null, null, null, null, null, t, n::int, null, null from tp
  union all select channel_a, channel_b, strength * 0.5, null, null, null, null, null, null, null, null, edges_a_to_b, edges_b_to_a from mutual),
mg as (select channel_a, channel_b, round(sum(part), 9)::double score, max(about_direction) about_direction, max(handle_token) handle_token, max(handle_token_channels) handle_token_channels, round(max(out_share), 9) out_share, max(out_share_edges) out_share_edges,
  max(out_share_src) out_share_src, max(shared_token) shared_token, max(shared_token_channels) shared_token_channels, max(edges_a_to_b) edges_a_to_b, max(edges_b_to_a) edges_b_to_a from al group by 1, 2)
select mg.* from mg left join fresh fa on fa.channel_id = channel_a left join fresh fb on fb.channel_id = channel_b
where (fa.family_key is null or fb.family_key is null or fa.family_key <> fb.family_key)
  and not exists (select 1 from inv where linked_to is not null and least(tg_id, linked_to) = channel_a and greatest(tg_id, linked_to) = channel_b)""",
    "current_decisions": f"select least(x, y) a, greatest(x, y) b, max(run_id) run_id, arg_max(d, run_id) decision from (select {BARE.format('channel_a')} x, {BARE.format('channel_b')} y, lower(trim(decision)) d, run_id from affiliation_candidates) where x <> y group by 1, 2",
    "decision_counts": f"with recursive {PAIRS} select d decision, count(*)::bigint pairs from pairs group by 1",
    "cascade_crossings": f"""with recursive {REPOSTS}, fc as (select channel_id, msg_id, count(distinct src_family)::bigint families from rp
  where src_family <> dst_family and published_at >= dst_published_at and epoch_us(published_at) - epoch_us(dst_published_at) <= 240 * 3600 * 1000000::bigint group by 1, 2)
select channel_id, msg_id, band::int band, families from fc, (select unnest([1, 2, 3]) band) where families >= band""",
    "cited_ranking": f"with recursive {REPOSTS} select channel_id, msg_id, count(distinct src_family)::bigint families, count(distinct src)::bigint sources, epoch(min(dst_published_at))::bigint published from rp where src_family <> dst_family group by 1, 2 having count(distinct src_family) > 1",
    "incoming_references": f"with {EDGES} select dst dst_channel_id, src src_channel_id, count(*) filter (kind = 'forward')::bigint forwards, count(*) filter (kind = 'mention')::bigint mentions, epoch(max(published_at))::bigint last_at from e group by 1, 2",
    "outgoing_references": f"with {EDGES} select src src_channel_id, kind, count(*)::bigint refs, count(distinct dst)::bigint targets from e group by 1, 2",
    "mature_medians": f"with {READINGS} select channel_id, metric, round(median, 6) median, samples from med",
    "age_bands": f"with {READINGS} select metric, band, count(*)::bigint n from rd group by 1, 2",
    "growth_curves": f"with {READINGS} select kind, metric, band, round(fraction, 6) fraction, samples from curve",
    "growth_factors": f"with {READINGS} select kind, metric, round(factor, 6) factor from factor",
    "baseline_fit": f"with {READINGS} select kind, metric, band, round(fraction, 6) fraction, round(factor, 6) factor, round(spread, 6) spread, borrowed from fit",
    "spike_scores": spikes(NOW),
    "spike_replay": spikes(REPLAYED),
    "ranked_scores": f"with {READINGS}, {scores(NOW)} select channel_id, msg_id, epoch(observed_at)::bigint observed_at, metric, round(z, 5) z, row_number() over (partition by channel_id, msg_id, observed_at order by z desc, case metric when 'views' then 0 when 'reactions' then 1 else 2 end)::int place from sc",
    "scoring_summary": f"""with {READINGS}, {scores(NOW)} select (select count(*) from (select distinct channel_id, msg_id from sc_post))::bigint posts, (select count(*) from (select distinct channel_id, msg_id from sc))::bigint scored, (select count(*) from sc_spike)::bigint crossed,
  (select count(*) from inv where status = 'seed' and not is_chat and tg_id % 7 <> 0)::bigint channels_in_scope, (select count(distinct channel_id) from med)::bigint channels_with_baseline""",
    "spike_alerts": f"with {READINGS}, {scores(NOW)}, {scores(REPLAYED, 'old')} select 'spike' kind, channel_id, msg_id, 1::int band, round(z, 5) \"value\" from sc_spike s where not exists (select 1 from old_spike o where o.channel_id = s.channel_id and o.msg_id = s.msg_id)",
    "default_bands": "select band, count(*)::bigint n from (select (msg_id % 7000) / 10.0 age, case when age < 10 then null when age < 15 then '10m' when age < 22 then '15m' when age < 33 then '22m' when age < 48 then '33m' when age < 70 then '48m' when age < 105 then '70m' when age < 150 then '105m' when age < 220 then '150m' when age < 320 then '220m' when age < 420 then '320m' when age < 570 then '420m' end band from raw_messages) group by 1",
    "reference_variety": f"with recursive collected as (select distinct channel_id from raw_messages), {OUTWARD} select channel_id, round(out_variety, 6) out_variety, out_targets, in_sources, round(reciprocity, 6) reciprocity from variety",
    "post_medians": f"with {POSTS}, {MEDIANS} select channel_id, posts, " + ", ".join(f"round({c}, 6) {c}" for c in ("median_views", "median_reactions", "median_forwards", "reaction_rate", "forward_rate", "comment_rate")) + " from pm",
    "scorecard": f"""with recursive {POSTS}, collected as (select distinct channel_id from posts), {OUTWARD}, {MEDIANS}, {INVENTORY}, {ABOUT}
select tg_id channel_id, title, username, kind, coalesce(f.family_key, tg_id) family_key, subscribers, coalesce(posts, 0) posts, """
    + ", ".join(f"round({c}, 6) {c}" for c in ("median_views", "median_reactions", "median_forwards", "reaction_rate", "forward_rate", "comment_rate", "out_variety"))
    + """, coalesce(out_targets, 0) out_targets, coalesce(in_sources, 0) in_sources, round(reciprocity, 6) reciprocity
from inv left join fresh f on f.channel_id = tg_id left join ab on ab.channel_id = tg_id left join pm on pm.channel_id = tg_id left join variety v on v.channel_id = tg_id where status = 'seed'""",
    "text_measures": f"with {POSTS}, {STYLE} select channel_id, text_posts, " + ", ".join(f"round({c}, 6) {c}" for c in ("median_len", "p90_len", "sentence_len", "quote_share", "code_share", "latin_share", "link_density", "emoji_density", "emphatic_density")) + " from ms",
    "style_scores": f"""with {POSTS}, {STYLE}, big as (select * from ms where text_posts >= 5)
select channel_id, text_posts, round(list_avg(list_filter([{", ".join(z(c, t) for c, t in (("median_len", "log"), ("sentence_len", "log"), ("quote_share", "sqrt"), ("code_share", "sqrt"), ("link_density", "sqrt")))}], lambda x: x is not null)), 6) depth,
  round(list_avg(list_filter([{", ".join("-" + z(c, "sqrt") for c in ("emoji_density", "emphatic_density"))}], lambda x: x is not null)), 6) dryness from big""",
    "anomaly_z": f"with recursive {ANOMALY} select channel_id, msg_id, " + ", ".join(f"round({c}, 5) {c}" for c in ("views_lift", "views_z", "reaction_z", "forward_z", "comment_z")) + " from zs",
    "anomaly_picks": f"with recursive {ANOMALY} select channel_id, msg_id, rank::int rank, round(forward_z, 5) forward_z from (select *, row_number() over (partition by channel_id order by forward_z desc, msg_id) rank from zs where forward_z >= 2.0) where rank <= 3",
    "views_below": "select tg_id, s.subscribers, round(case when s.subscribers is not null then (rank() over (order by s.subscribers nulls last) - 1) / (count(s.subscribers) over ()) end, 6) subscribers_below from channel_scorecard s",
    "status_counts": f"with {INVENTORY} select s status, count(inv.tg_id)::bigint channels from (select unnest(['candidate', 'seed', 'maybe', 'rejected']) s) left join inv on inv.status = s group by 1",
    "freshness": "select (select epoch(max(derived_at))::bigint from edges) derived_at, (select epoch(max(published_at))::bigint from edges) referenced_at, (select epoch(max(fetched_at))::bigint from raw_messages) fetched_at",
    "decayed_edges": f"with {DECAYED} select src, dst, kind, round(weight, 6) weight, n from d",
    "balanced_pairs": f"""with {DECAYED}, u as (select least(src, dst) a, greatest(src, dst) b, kind, sum(weight) w from d where src <> dst group by all), m as (select kind, sum(w) m from u group by 1)
select a, b, round(sqrt(sum(w * (select max(m) from m) / m.m)), 5) weight from u join m using (kind) group by 1, 2""",
    "partition_nmi": f"""with {INVENTORY}, c as (select list_position({KINDS}, kind) l, list_position({STATUSES}, status) r, count(*) n from inv where kind is not null group by 1, 2), t as (select sum(n) t from c), a as (select l, sum(n) n from c group by 1), b as (select r, sum(n) n from c group by 1),
h as (select (select -sum(n / t * ln(n / t)) from a, t) hl, (select -sum(n / t * ln(n / t)) from b, t) hr, (select sum(c.n / t * ln(c.n * t / (a.n * b.n))) from c join a using (l) join b using (r), t) mi)
select round(case when sqrt(hl * hr) > 0 then mi / sqrt(hl * hr) else 1.0 end, 6) nmi from h""",
    "inside_share": f"with {LABELLED} select home community, kind, round(sum(case when home = other then sqrt(weight) else 0 end) / sum(sqrt(weight)), 5) inside from ends group by 1, 2",
    "outward_lean": f"""with {LABELLED}, o as (select node, home, other, sqrt(sum(weight)) w from ends where home <> other group by all)
select node, home community, other leans_to, round(w / t, 4) lean from (select *, sum(w) over (partition by node) t, row_number() over (partition by node, home order by round(w, 9) desc, other) rn from o) where rn = 1""",
    "bridge_nodes": f"with {LABELLED} select node, home community, count(*)::bigint partners, round(sum(case when home = other then weight else 0 end) / sum(weight), 5) inside_share from ends group by 1, 2 having count(*) >= 5",
    "term_odds": """with t as (select doc_id, doc_type, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}{4,}'))) term from documents where text is not null and doc_type is not null),
i as (select doc_type, term, count(*) n from t group by all), a as (select term, sum(n) a from i group by 1), s as (select doc_type, count(*) size, sum(count(*)) over () total from documents where text is not null and doc_type is not null group by 1),
o as (select doc_type, term, n::bigint n, round(ln((n + 0.5) / (size - n + 0.5) / ((a - n + 0.5) / (total - size - a + n + 0.5))), 6) odds from i join a using (term) join s using (doc_type) where n >= least(3, greatest(2, floor(size / 4))))
select doc_type, rank::int rank, term, n, odds from (select *, row_number() over (partition by doc_type order by odds desc, term) rank from o) where rank <= 5""",
    "due_queue": f"with {INVENTORY}, {STATE} select tg_id, epoch(due_at)::bigint due_at from inv left join state using (tg_id) where status = 'seed' and not is_chat and (due_at is null or due_at <= {NOW}) order by due_at nulls first, tg_id limit 25",
    "queue_lag": f"with {INVENTORY}, {STATE} select count(*) filter (due_at is null or due_at <= {NOW})::bigint overdue, epoch(min(due_at) filter (due_at <= {NOW}))::bigint oldest_due, count(due_at)::bigint tracked from inv left join state using (tg_id) where status = 'seed' and not is_chat",
    "post_rates": f"with {POSTS}, {RATES} select channel_id, round(posts_per_day, 6) posts_per_day from rates",
    "poll_schedule": f"""with {POSTS}, {RATES} select channel_id, round(greatest(30, least(720, 1440 / posts_per_day * 0.25)), 6)::double idle, greatest(10, least(100, floor(posts_per_day * 49 / 24) + 2))::int "window",
  list_min(list_filter([15, 30, 60, 120, 240, 480, 1440, 2880], lambda o: o > posts_per_day * 60))::double sample, round(2.25 * pow(2, channel_id % 3), 6)::double backoff from rates""",
    "metadata_due": f"with {INVENTORY}, f as (select channel_id tg_id, max(fetched_at) fetched_at from raw_channels group by 1) select tg_id, epoch(fetched_at)::bigint fetched_at from inv left join f using (tg_id) where fetched_at is null or fetched_at < {NOW} - interval 14 day",
    "awaiting_resolution": f"with {INVENTORY} select tg_id from inv where resolved_at is null and coalesce(resolve_attempts, 0) = 0",
}
