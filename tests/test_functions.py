from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewire.functions import ids, payload, robust, text, timing


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "name"), [("@Some_Name ", "some_name"), ("abc", None), ("1abcd", None), ("a" * 33, None), ("", None), (None, None), ("@@twice", None), ("name-x", None)])
def test_normalize_username(spark, raw, name):
    assert one(spark, raw, text.normalize_username("x")) == name


@pytest.mark.parametrize(("url", "expected"), [
    ("https://t.me/Some_name", ("some_name", None, None)), ("t.me/some_name/123?comment=4", ("some_name", None, 123)), ("http://www.telegram.me/s/some_name", ("some_name", None, None)),
    ("t.me/c/1234567890/55", (None, 1234567890, 55)), ("t.me/c/12345", (None, 12345, None)), ("t.me/c/abc", None), ("https://t.me/+AbCd", None), ("t.me/joinchat/xyz", None), ("t.me/addlist?slug=1", None),
    ("https://example.org/some_name", None), ("t.me/", None), ("t.me/s/", None), ("telegram.dog/some_name/word", ("some_name", None, None)), ("", None), (None, None),
])
def test_parse_link(spark, url, expected):
    got = one(spark, url, text.parse_link("x"))
    assert (tuple(got) if got else None) == expected


def test_entities_count_utf16_units(spark):
    message = "🎉👩‍💻 see @Some_name and t.me/other/7"
    units = lambda s: len(s.encode("utf-16-le")) // 2
    at = lambda s: units(message[: message.index(s)])
    p = {"_": "Message", "message": message, "entities": [
        {"_": "MessageEntityMention", "offset": at("@Some"), "length": 10}, {"_": "MessageEntityUrl", "offset": at("t.me"), "length": 12},
        {"_": "MessageEntityTextUrl", "offset": 0, "length": 2, "url": "https://t.me/hidden_one"}, {"_": "MessageEntityBold", "offset": 0, "length": 2},
    ]}
    refs = one(spark, json.dumps(p), text.entity_references(payload.parse("x")["message"], payload.parse("x")["entities"]))
    assert [tuple(r) for r in refs] == [("some_name", None, None), ("other", None, 7), ("hidden_one", None, None)]


def test_text_references_and_handles(spark):
    about = "Ads: @Some_bot. More (https://t.me/other_one/5). mail@x @share @1red2black"
    assert [tuple(r) for r in one(spark, about, text.text_references("x"))] == [("other_one", None, 5), ("some_bot", None, None)]
    assert one(spark, about, text.handles("x")) == ["some_bot", "share", "1red2black"]
    assert one(spark, None, text.text_references("x")) is None


def test_small_text_functions(spark):
    assert sorted(one(spark, "Some-Name_one_ab_name", text.username_tokens("x"))) == ["name", "some"]
    assert one(spark, " a\n b  c ", text.one_line("x")) == "a b c"
    assert one(spark, "word " * 60, text.excerpt("x", 12)) == "word word wo…"
    assert one(spark, "name", text.post_link("x", F.lit(5))) == "https://t.me/name/5"
    assert one(spark, None, text.post_link("x", F.lit(5))) is None
    assert one(spark, "a🎉!? Z", text.count_of("x", text.EMOJI)) == 1
    assert one(spark, "# comment", text.valid_entry("x")) is None
    assert one(spark, "https://t.me/+invite", text.valid_entry("x")) is None
    assert one(spark, "@Good_name", text.valid_entry("x")) == "good_name"


@pytest.mark.parametrize(("value", "bare"), [(1101983292, 1101983292), (-1001101983292, 1101983292), (None, None), (-5, -5)])
def test_bare_id(spark, value, bare):
    assert one(spark, value, ids.bare_id("x"), "bigint") == bare


@pytest.mark.parametrize(("reactions", "strict", "empty_null", "zero"), [
    (None, None, None, 0), ({"results": None}, None, None, 0), ({"results": []}, 0, None, 0),
    ({"results": [{"count": 3, "reaction": {"_": "ReactionEmoji", "emoticon": "x"}}, {"count": 2, "reaction": {"_": "ReactionPaid"}}]}, 5, 5, 5),
])
def test_reactions_null_is_not_zero(spark, reactions, strict, empty_null, zero):
    doc = json.dumps({"_": "Message", "reactions": reactions})
    got = [one(spark, doc, payload.reaction_total(payload.parse("x")["reactions"], mode)) for mode in payload.MODES]
    assert got == [strict, empty_null, zero]


def test_reaction_keys_sum_and_bool_is_no_counter(spark):
    results = [{"count": 1, "reaction": {"_": "ReactionNew"}}, {"count": 2, "reaction": {"_": "ReactionOther"}}, {"count": 4, "reaction": {"_": "ReactionCustomEmoji", "document_id": 9}}, {"count": None, "reaction": {"_": "ReactionPaid"}}]
    doc = json.dumps({"_": "Message", "views": True, "reactions": {"results": results}})
    assert one(spark, doc, payload.reaction_map(payload.parse("x")["reactions"])) == {"unknown": 3, "custom:9": 4}
    assert one(spark, doc, payload.parse("x")["views"]) is None


@pytest.mark.parametrize(("minutes", "band"), [(9.99, None), (10.0, "10m"), (14.999, "10m"), (15.0, "15m"), (569.0, "420m"), (570.0, None), (None, None)])
def test_bands_leave_no_gap(spark, minutes, band):
    assert one(spark, minutes, timing.band_of(F.col("x")), "double") == band
    assert timing.reference_band() == "420m"


@pytest.mark.parametrize(("at", "start", "end", "inside"), [("2026-01-01 23:30:00", 23, 8, True), ("2026-01-01 07:59:00", 23, 8, True), ("2026-01-01 08:00:00", 23, 8, False), ("2026-01-01 10:00:00", 9, 12, True), ("2026-01-01 10:00:00", 5, 5, False)])
def test_quiet_window_passes_midnight(spark, at, start, end, inside):
    assert one(spark, at, timing.in_quiet_window(F.to_timestamp("x"), start, end)) is inside


def test_schedule(spark):
    d = lambda c, v: one(spark, v, c, "double")
    assert d(timing.next_sample(F.col("x")), 15.0) == 30.0 and d(timing.next_sample(F.col("x")), 2880.0) is None
    assert d(timing.idle_interval(F.col("x")), None) == 720 and d(timing.idle_interval(F.col("x")), 1000.0) == 30 and d(timing.idle_interval(F.col("x")), 1.0) == 360
    assert d(timing.window_size(F.col("x")), 0.0) == 10 and d(timing.window_size(F.col("x")), 20.0) == 42
    assert d(timing.backoff(F.lit(9), F.col("x")), 2.0) == 1.5**4 * 4
    with pytest.raises(ValueError):
        timing.Schedule(least=10, most=5)


def test_robust_parts(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 1000])], "i int, v double")
    z = {r["i"]: r["v_z"] for r in robust.robust_z(df, {"v": "none"}).collect()}
    assert z[2] == 0 and z[4] == 4 and round(z[0], 4) == round(-2 / 1.4826, 4)
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, v double")
    assert [r["v_z"] for r in robust.robust_z(flat, {"v": "none"}).collect()] == [None, None]
    got = robust.group_spread(df.withColumn("g", F.lit(1)), ["g"], ["v"]).first()
    assert got["v_median"] == 3 and got["v_spread"] > 1.4826
