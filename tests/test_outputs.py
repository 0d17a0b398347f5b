from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path

import pytest

from tidewire import cli
from tidewire.sources import sinks, store

DATA = Path("/root/testdata/sf0.001")


def test_gexf_is_one_document(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a&b", 'T "x" <y>', None), (2, None, None, "media")], "tg_id bigint, username string, title string, kind string")
    edges = spark.createDataFrame([(1, 2, 0.5, 3), (2, 1, 1.25, 1)], "src bigint, dst bigint, weight double, n bigint")
    sinks.graph(nodes, edges, str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    root = ET.fromstring(text.encode())
    ids = [e.attrib.get("id") or e.attrib.get("source") for e in root.iter() if e.tag.endswith(("}node", "}edge"))]
    assert ids == ["1", "2", "1", "2"]


def test_sheets_and_markdown(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, ["a", "b"], "x|y\nz"), (2, None, None)], "id int, l array<string>, t string")
    sinks.sheet(df, str(tmp_path / "s"))
    assert rows(spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "s")), "id", "l")[0] == ("1", '["a","b"]')
    assert rows(sinks.markdown(df.select("id", "t"))) == [("| 1 | x\\|y z |",), ("| 2 | — |",)]
    with pytest.raises(ValueError):
        sinks.sheet(df, str(tmp_path / "s"), "xlsx")


def test_entries_and_dialogs(spark, tmp_path, rows):
    (tmp_path / "names.txt").write_text("# comment\n@Good_name\n\nt.me/other_one/5\nt.me/+invite\n")
    assert rows(store.read_entries(spark, str(tmp_path / "names.txt")), "username") == [("good_name",), ("other_one",), (None,)]
    dialogs = spark.createDataFrame([("channel", 1, "a", "t"), ("megagroup", 2, "b", "t"), ("channel", 3, None, "t"), ("user", 4, "c", None)], "type string, id bigint, username string, title string")
    assert rows(store.public_dialogs(dialogs), "tg_id", "is_chat") == [(1, False), (2, True)]


def seed_id():
    return str(duckdb_first("select min(tg_id) from channels where status = 'seed' and tg_id > 0"))


def duckdb_first(sql):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"create view channels as select * from '{DATA}/channels.parquet'")
    return db.execute(sql).fetchone()[0]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("command", [
    ["family"], ["family", "--confirm", "1", "2", "3"], ["derive"], ["channels", "--status", "seed"], ["query", "status_counts"], ["query", "deferred_chats"], ["graph"], ["affiliates", "--stored", "--all", "--any-status", "--limit", "5"],
    ["affiliates", "--edge-kind", "forward", "--min-out-edges", "2", "--any-status"], ["mark", seed_id, "--status", "rejected", "--reason", "spam"], ["report", seed_id], ["watch-status"], ["metadata"], ["resolve", "--limit", "3"],
])
def test_commands(spark, tmp_path, command):
    cli.main([*[c() if callable(c) else c for c in command], "--data", str(DATA), "--out", str(tmp_path / "out")])
    assert any((tmp_path / "out").glob("part-*"))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_report_is_one_document(spark, tmp_path):
    cli.main(["report", seed_id(), "--data", str(DATA), "--out", str(tmp_path / "out")])
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert [line for line in text.splitlines() if line.startswith("## ")] == ["## Collected", "## Referenced by", "## References", "## Posts that travelled", "## Other channels of the author"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_add_and_floods(spark, tmp_path, rows):
    name = duckdb_first("select lower(min(username)) from channels where username is not null and not starts_with(username, '@')")
    (tmp_path / "names.txt").write_text(f"@Brand_new_name\n{name}\nt.me/+invite\n")
    for flags, expected in (([], ["brand_new_name"]), (["--failures"], ["t.me/+invite"])):
        cli.main(["add", str(tmp_path / "names.txt"), *flags, "--data", str(DATA), "--out", str(tmp_path / "out")])
        assert [r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == expected
    spark.sql("select * from values ('a', 5, timestamp '2026-01-01 00:00:00', false), ('a', 9, timestamp '2026-01-02 00:00:00', true) as t(method, seconds, at, halted)").write.parquet(str(tmp_path / "floods.parquet"))
    cli.main(["floods", "--limit", "1", "--data", str(tmp_path), "--out", str(tmp_path / "out")])
    assert [r["seconds"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [9]
    cli.main(["floods", "--summary", "--data", str(tmp_path), "--out", str(tmp_path / "out")])
    assert rows(spark.read.parquet(str(tmp_path / "out")), "method", "floods", "longest") == [("a", 2, 9)]
