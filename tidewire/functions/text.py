"""Usernames, links, mentions and text measures as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.ids import col

#: Hosts of public links and first path words that name an action (fixed values).
HOSTS = ("t.me", "telegram.me", "telegram.dog")
SERVICE_WORDS = ("addemoji", "addlist", "addstickers", "addtheme", "boost", "confirmphone", "contact", "giftcode", "invoice", "joinchat", "login", "proxy", "setlanguage", "share", "socks")
USERNAME = r"^[a-z][a-z0-9_]{3,31}$"
TEXT_LINK = r"(?i)((?:https?://)?(?:www\.)?(?:t|telegram)\.(?:me|dog)/\S+)"
TEXT_MENTION = r"@([A-Za-z][A-Za-z0-9_]{3,31})"
HANDLE = r"@([A-Za-z0-9][A-Za-z0-9_]{3,31})"
#: Punctuation that a link takes along from the sentence around it.
TRAILING = r"""[.,;:!?)\]}>"'»…]+$"""
REFERENCE = "struct<username: string, channel_id: bigint, msg_id: bigint>"


def normalize_username(raw: Column | str) -> Column:
    """Trimmed, without one leading @, in lower case; null if it cannot be a username."""
    name = F.lower(F.regexp_replace(F.trim(col(raw)), r"^@", ""))
    return F.when(name.rlike(USERNAME), name)


def reference(username: Column | None = None, channel_id: Column | None = None, msg_id: Column | None = None) -> Column:
    """A reference by name or by id, optionally to one post."""
    part = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(part(username, "string").alias("username"), part(channel_id, "bigint").alias("channel_id"), part(msg_id, "bigint").alias("msg_id"))


def parse_link(url: Column | str) -> Column:
    """What a public link names, or null: a channel, a post of it, its preview (/s/), or a bare id (/c/).

    Invitations (+...), service words and other hosts name nothing.
    """
    raw = F.trim(col(url))
    rest = F.regexp_replace(raw, r"^[^/]*//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), r"^www\.", "")
    parts = F.filter(F.split(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    at = lambda i: F.get(parts, F.lit(i))
    digits = lambda i: F.when(at(i).rlike(r"^[0-9]{1,18}$"), at(i).cast("bigint"))
    named = lambda c: F.when(~normalize_username(c).isin(*SERVICE_WORDS), normalize_username(c))
    first = F.lower(at(0))
    kind = F.when(first == "c", F.when(digits(1).isNotNull(), reference(channel_id=digits(1), msg_id=digits(2))))
    kind = F.when(first == "s", F.when(named(at(1)).isNotNull(), reference(username=named(at(1))))).when(first == "c", kind)
    kind = kind.when(named(at(0)).isNotNull() & (first != "s") & (first != "c"), reference(username=named(at(0)), msg_id=digits(1)))
    return F.when(host.isin(*HOSTS) & ~at(0).startswith("+"), kind)


def utf16_slice(text: Column | str, offset: Column, length: Column) -> Column:
    """The part of a text that an entity covers; offset and length count UTF-16 code units."""
    return F.decode(F.substring(F.encode(col(text), "UTF-16LE"), 2 * offset + 1, 2 * length), "UTF-16LE")


def entity_references(text: Column | str, entities: Column | str) -> Column:
    """All references of a message by entity, in order: mentions, written links and links behind text."""

    def one(e: Column) -> Column:
        covered = utf16_slice(text, e["offset"], e["length"])
        name = normalize_username(covered)
        return (
            F.when(e["_"] == "MessageEntityMention", F.when(name.isNotNull(), reference(username=name)))
            .when(e["_"] == "MessageEntityUrl", parse_link(covered))
            .when(e["_"] == "MessageEntityTextUrl", parse_link(e["url"]))
        )

    return F.filter(F.transform(col(entities), one), lambda r: r.isNotNull())


def text_references(text: Column | str) -> Column:
    """All references of a plain text without entities: links first, then mentions."""
    text = col(text)
    links = F.transform(F.regexp_extract_all(text, F.lit(TEXT_LINK), F.lit(1)), lambda u: parse_link(F.regexp_replace(u, TRAILING, "")))
    names = F.transform(F.regexp_extract_all(text, F.lit(TEXT_MENTION), F.lit(1)), normalize_username)
    mentions = F.transform(F.filter(names, lambda n: n.isNotNull() & ~n.isin(*SERVICE_WORDS)), lambda n: reference(username=n))
    return F.concat(F.filter(links, lambda r: r.isNotNull()), mentions)


def handles(text: Column | str) -> Column:
    """Distinct handles that a text names, in lower case; unlike usernames they may begin with a digit."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(HANDLE), F.lit(1)), F.lower))


def username_tokens(username: Column | str, least: int = 4) -> Column:
    """Distinct parts of a username, split at _ and -, of at least the given length."""
    parts = F.split(F.regexp_replace(F.lower(col(username)), "-", "_"), "_")
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) >= least))


def one_line(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def excerpt(text: Column | str, limit: int = 200) -> Column:
    """The text on one line, cut with an ellipsis where it is longer."""
    line = one_line(text)
    return F.when(F.length(line) > limit, F.concat(F.rtrim(F.substring(line, 1, limit)), F.lit("…"))).otherwise(line)


def post_link(username: Column | str, msg_id: Column | str, host: str = "t.me") -> Column:
    """The public link of a post; null for a channel without username."""
    return F.concat(F.lit(f"https://{host}/"), col(username), F.lit("/"), col(msg_id).cast("string"))


#: What the style measures count (fixed values).
SENTENCE_END = "[.!?…\n]+"
LATIN = "[A-Za-z]"
CYRILLIC = "[А-Яа-яЁё]"
EMPHATIC = "[!?]"
EMOJI = "[\\x{1F300}-\\x{1FAFF}☀-➿]"


def count_of(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern)).cast("bigint")


def valid_entry(line: Column | str) -> Column:
    """A username from an operator's entry: a bare name, @name or a public link; null for invitations and anything else."""
    line = F.trim(col(line))
    named = F.when(line.contains("/"), parse_link(line)["username"]).otherwise(normalize_username(line))
    return F.when((line != "") & ~line.startswith("#"), named)
