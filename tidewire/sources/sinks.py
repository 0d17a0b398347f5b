"""Writers of sheets and graphs, all distributed: the driver sees no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sheet(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A sheet as CSV with a header, JSON lines or Parquet; maps, arrays and structs become JSON text in CSV."""
    if kind == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        df = df.withColumns({c: F.to_json(c) for c in nested})
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("json", "parquet"):
        df.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError("kind must be csv, json or parquet")


def escaped(c: str) -> Column:
    """Text as the value of an XML attribute."""
    out = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a GEXF document in order: nodes (tg_id, username, title, kind) and weighted directed edges (src, dst, weight, n).

    Lines are sorted by a range shuffle, so ``graph`` can write a large graph from many tasks; part files follow in order.
    """
    spark = nodes.sparkSession
    head = [
        (0, '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">'),
        (1, '<attributes class="node"><attribute id="0" title="title" type="string"/><attribute id="1" title="kind" type="string"/></attributes><nodes>'),
        (3, "</nodes><edges>"), (5, "</edges></graph></gexf>"),
    ]
    frame = spark.createDataFrame([(o, "", line) for o, line in head], "part int, key string, line string")
    label = F.coalesce("username", F.col("tg_id").cast("string"))
    labelled = nodes.withColumn("_label", label)
    node = F.concat(F.lit('<node id="'), F.col("tg_id").cast("string"), F.lit('" label="'), escaped("_label"), F.lit('"><attvalues><attvalue for="0" value="'), escaped("title"), F.lit('"/><attvalue for="1" value="'), escaped("kind"), F.lit('"/></attvalues></node>'))
    edge = F.concat(F.lit('<edge source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), F.lit('" weight="'), F.round("weight", 6).cast("string"), F.lit('"/>'))
    lines = frame.unionByName(labelled.select(F.lit(2).alias("part"), F.col("tg_id").cast("string").alias("key"), node.alias("line")))
    lines = lines.unionByName(edges.select(F.lit(4).alias("part"), F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("key"), edge.alias("line")))
    return lines.orderBy("part", "key").select("line")


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write the GEXF lines as text part files that make one document in name order."""
    gexf(nodes, edges).write.mode("overwrite").text(path)


def markdown(df: DataFrame) -> DataFrame:
    """The rows of a report section as lines of a table; the heading lines are ``markdown_heading``."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("|"), F.lit("\\|")), r"\s+", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))


def markdown_heading(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]


def document(spark, sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """Titled tables as the lines of one Markdown document in order; a table without rows says so. The tables are small."""
    lines: list[str] = []
    for title, df in sections:
        rows = [r["line"] for r in markdown(df).collect()]
        lines += [f"## {title}", "", *([*markdown_heading(df.columns), *rows] if rows else ["Nothing."]), ""]
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string").coalesce(1).orderBy("place").select("line")
