"""Encoding with a public byte-level BPE by recursive queries.

Each Python worker keeps one in-process DuckDB with the merge table. The distinct words of a batch that it has not met
yet become rows (word, tokens); a recursive query keyed by word joins each word's token positions with the merge table
and contracts the leftmost pair of least rank until no pair of the word is in the table. Rows of finished words drop
out of the recursion by themselves. Decoding is an ordered aggregation of the tokens' bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import spread

#: Default place of the public vocabulary files; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: The public pattern that splits text into words before the merges (fixed value of the encoding).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: One thread a worker, bounded memory and no spilling into the worker's folder.
DUCKDB = {"threads": 1, "memory_limit": "600MB", "temp_directory": ""}
#: Words a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 200_000

#: A step contracts the leftmost pair of least rank of each word and, as the same pair stays the least until none is left,
#: its further occurrences from the left without overlap. A pair that a contraction makes holds the new token and always
#: ranks after it (``Vocabulary`` checks that), so the result is that of leftmost contractions one by one, at every length.
CONTRACT = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
  SELECT word, toks FROM words
  UNION
  SELECT word, list(CASE WHEN take THEN id ELSE tok END ORDER BY pos) FILTER (NOT gone)
  FROM (
    SELECT word, pos, tok, id, take, lag(take, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone
    FROM (
      SELECT word, pos, tok, id, tok = l AND coalesce(follows = r, false) AND (l <> r OR (pos - starts) % 2 = 0) AS take
      FROM (
        SELECT t.word, t.pos, t.tok, b.best.id AS id, b.best.l AS l, b.best.r AS r,
               lead(t.tok) OVER (PARTITION BY t.word ORDER BY t.pos) AS follows,
               max(CASE WHEN t.new THEN t.pos END) OVER (PARTITION BY t.word ORDER BY t.pos) AS starts
        FROM (
          SELECT word, pos, toks[pos] AS tok, pos = 1 OR toks[pos] <> toks[pos - 1] AS new
          FROM (SELECT word, toks, unnest(range(1, len(toks) + 1)) AS pos FROM state)
        ) t
        JOIN (
          SELECT p.word, min({'id': m.id, 'l': m.l, 'r': m.r}) AS best
          FROM (SELECT word, toks, unnest(range(1, len(toks))) AS pos FROM state) p
          JOIN merges m ON m.l = p.toks[p.pos] AND m.r = p.toks[p.pos + 1]
          GROUP BY p.word
        ) b ON b.word = t.word
      )
    )
  ) GROUP BY word
) SELECT word, toks FROM state ORDER BY word
"""

DECODE = """
SELECT t.doc, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM encoded) t
JOIN vocabulary v ON v.id = t.id
GROUP BY t.doc
"""


def byte_letters() -> dict[str, int]:
    """The public byte-to-letter table of byte-level vocabularies: printable bytes stand for themselves, the rest follow 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Vocabulary:
    """Merge table and bytes of every token, as arrays of fixed size (some 50 thousand entries)."""

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY):
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, letters = model["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype="int32")
        self.right = np.array([ids[b] for _, b in pairs], dtype="int32")
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype="int32")
        if (np.diff(self.merged) <= 0).any():
            raise ValueError("merges must be listed in the order of their ids")
        self.single = np.empty(256, dtype="int32")
        for letter, b in letters.items():
            self.single[b] = ids[letter]
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}


class Encoder:
    """One worker's DuckDB and its memory of words."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        import duckdb
        import regex

        self.pattern, self.single, self.remembered = regex.compile(PATTERN), vocabulary.single, remembered
        self.known: dict[str, bytes] = {}
        self.db = duckdb.connect(config=DUCKDB)
        merges = pa.table({"l": vocabulary.left, "r": vocabulary.right, "id": vocabulary.merged})  # noqa: F841
        self.db.register("given", merges)
        self.db.execute("create table merges as select * from given")
        self.db.unregister("given")

    def learn(self, words: list[str]) -> None:
        """Encode words and remember them."""
        tokens = pa.array([self.single[np.frombuffer(w.encode("utf-8", "surrogatepass"), dtype=np.uint8)] for w in words], pa.list_(pa.int32()))
        self.db.register("words", pa.table({"word": pa.array(range(len(words)), pa.int32()), "toks": tokens}))
        done = self.db.sql(CONTRACT).to_arrow_table()["toks"].combine_chunks()
        self.db.unregister("words")
        flat, ends = np.ascontiguousarray(done.flatten().to_numpy(zero_copy_only=False), dtype="int32"), done.offsets.to_numpy()
        ends = ends - ends[0]
        for w, i, j in zip(words, ends[:-1], ends[1:]):
            self.known[w] = flat[i:j].tobytes()

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        split = [self.pattern.findall(t) if t else () for t in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        fresh = set().union(*split) - self.known.keys()
        if fresh:
            self.learn(sorted(fresh))
        known = self.known
        rows = [b"".join([known[w] for w in words]) for words in split]
        offsets = np.zeros(len(rows) + 1, dtype="int32")
        np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype="int32")))


def in_pieces(batch: pa.RecordBatch, column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each, so that a batch of long texts stays small in memory."""
    ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype="int64"))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """key and ids of each row's text, without special tokens; an empty list for an empty and for a null text.

    The strings of special tokens are ordinary text. Repeated rows are encoded each. No shuffle: one pass over the rows.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast(Vocabulary(folder, name))  # of fixed size, under 3 MB
    kind = documents.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for whole in batches:
            for batch in in_pieces(whole, "text"):
                ids = encoder.encode(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("key"), ids], ["key", "ids"])

    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """key and text of each row's ids by ordered aggregation of their bytes; invalid bytes become U+FFFD, an empty list ''."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary(folder, name))
    kind = encoded.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config=DUCKDB)
        table = vocabulary.value.bytes
        db.register("given", pa.table({"id": pa.array(list(table), pa.int32()), "hex": [b.hex() for b in table.values()]}))
        db.execute("create table vocabulary as select * from given")
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                db.register("encoded", pa.table({"doc": pa.array(range(batch.num_rows), pa.int32()), "ids": batch.column("ids")}))
                found = dict(db.execute(DECODE).fetchall())
                texts = [bytes.fromhex(found.get(i, "")).decode("utf-8", "replace") for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    rows = encoded.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
