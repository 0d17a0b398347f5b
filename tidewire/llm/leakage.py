"""Evaluation passages inside a corpus.

Texts are folded to words (case, Unicode form, look-alike letters, invisible characters, markup and line breaks do not
count). Every window of WINDOW words of an item, and of a document, is embedded by CGK random walks: a walk copies the
word it stands on and steps on by a random bit of (step, word), which turns few edits into few differing positions.
Sampled positions of several walks are hashed; windows that share a hash are candidates. Every candidate, however few its
hashes, is aligned: first in a band around the place where the windows meet, which holds any least passage through them,
and, if that suffices, with the whole item around it, which counts the words in a row exactly.

A document window is embedded only if most of its words occur in some item: no other window can be within the allowed
edits of an item window, so nothing is lost.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.tokens import in_pieces
from tidewire.session import spread

#: Look-alike letters, after lower-casing and decomposition, and the letter they are read as (fixed values).
LOOK_ALIKE = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
        "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ɡ": "g", "ı": "i", "ӏ": "l",
        "α": "a", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ε": "e", "ι": "i", "κ": "k", "τ": "t", "χ": "x",
    }
)
TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
BROKEN = re.compile("(?<=\\w)[-\u2010]\n\\s*(?=\\w)")
INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]")
MARKS = re.compile(r"[\u0300-\u036f]")
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The folded words of a text."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", INVISIBLE.sub("", text)))
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text or "\u2010\n" in text:
        text = BROKEN.sub("", text)
    text = text.lower()
    return WORD.findall(text if text.isascii() else text.translate(LOOK_ALIKE))


@dataclass(frozen=True)
class LeakParams:
    """A passage is at least ``least`` words of an item in a row, single edits in between; ``known`` of a window's words occur in items."""

    least: int = 13
    window: int = 10
    known: int = 7
    walks: int = 16
    samples: int = 9
    tables: int = 2
    shared_openings: int = 3
    seed: int = 20240229
    #: Words of items in one index block (about 50 MB in a worker), and blocks that one pass over the corpus tries.
    block_words: int = 150_000
    blocks_a_pass: int = 4

    @property
    def band(self) -> int:
        """How far from the diagonal of a shared window a least passage through it may run: the window and its edits.

        A row of ``least`` matches that starts at zero and stays above it holds fewer than half as many edits.
        """
        return self.window + self.least // 2

    @property
    def reach(self) -> int:
        """How far before and after a shared window a least passage through it may begin and end."""
        return self.least + self.least // 2 + self.window // 2


def without_openings(texts: list[list[str]], sentences: list[list[str]], shared: int) -> list[list[str]]:
    """Cut the first sentence off items where at least ``shared`` different texts open with it."""
    seen: dict[tuple, set] = {}
    for w, s in zip(texts, sentences):
        seen.setdefault(tuple(s), set()).add(tuple(w))
    return [w[len(s) :] if s and len(seen[tuple(s)]) >= shared else w for w, s in zip(texts, sentences)]


class Index:
    """Hash tables over the windows of a bounded block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], params: LeakParams):
        self.params = p = params
        by_text: dict[tuple, list[int]] = {}
        for item, w in items:
            by_text.setdefault(tuple(w), []).append(item)
        self.same = list(by_text.values())
        vocabulary = sorted({x for w in by_text for x in w})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0 is any other word
        self.texts = [np.array([self.ids[x] for x in w], dtype="int32") for w in by_text]
        rng = np.random.default_rng(p.seed)
        self.steps = 3 * p.window
        self.bits = rng.integers(0, 2, (p.walks, self.steps, len(vocabulary) + 1), dtype="int8")
        self.picked = np.stack([[rng.choice(self.steps, p.samples, replace=False) for _ in range(p.tables)] for _ in range(p.walks)])
        self.factors = rng.integers(1, 2**62, (p.walks, p.tables, p.samples), dtype="int64") | 1
        windows, owner, at = [], [], []
        for i, t in enumerate(self.texts):
            n = len(t) - p.window + 1
            if n > 0:
                windows.append(np.lib.stride_tricks.sliding_window_view(t, p.window))
                owner.append(np.full(n, i))
                at.append(np.arange(n))
        flat = np.concatenate(windows) if windows else np.empty((0, p.window), dtype="int32")
        self.owner = np.concatenate(owner) if owner else np.empty(0, dtype=int)
        self.at = np.concatenate(at) if at else np.empty(0, dtype=int)
        self.tables = []
        for h in self.hashes(flat):
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], order))

    def hashes(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """For each walk and table, a hash of the sampled positions of each window's embedding."""
        p, n = self.params, len(windows)
        padded = np.concatenate([windows, np.full((n, 1), -1, dtype=windows.dtype)], axis=1)
        rows = np.arange(n)
        for walk in range(p.walks):
            out = np.empty((self.steps, n), dtype="int64")
            at = np.zeros(n, dtype="int64")
            for j in range(self.steps):
                word = padded[rows, at]
                out[j] = word + 2
                at = np.minimum(at + self.bits[walk, j][np.maximum(word, 0)], p.window)
            for k in range(p.tables):
                mix = np.zeros(n, dtype="int64")
                for f, j in zip(self.factors[walk, k], self.picked[walk, k]):
                    mix = (mix ^ out[j]) * f
                    mix ^= mix >> 29
                yield mix

    def candidates(self, text: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """[doc, item text, place in ``text``, place in the item] rows, one a shared hash, of windows that start there.

        ``text`` holds the words of all documents, ``doc`` the document of each word.
        """
        p = self.params
        none = np.empty((0, 4), dtype="int64")
        if len(text) < p.window or not len(self.owner):
            return none
        upto = np.concatenate([[0], np.cumsum(text > 0)])
        dense = np.flatnonzero((upto[p.window :] - upto[: -p.window] >= p.known) & (doc[: len(doc) - p.window + 1] == doc[p.window - 1 :]))
        if not len(dense):
            return none
        windows = np.lib.stride_tricks.sliding_window_view(text, p.window)[dense]
        found = []
        for (keys, order), h in zip(self.tables, self.hashes(windows)):
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            many = high - low
            if not many.any():
                continue
            at = np.repeat(dense, many)
            start = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
            item = order[start + np.arange(len(at))]
            found.append(np.stack([doc[at], self.owner[item], at, self.at[item]], axis=1))
        return np.concatenate(found) if found else none

    def leaks(self, folded: list[list[str]]) -> list[tuple[int, int, int]]:
        """(document, item, words in a row) of every item of which a document of the batch holds a passage."""
        p, ids = self.params, self.ids
        texts = [np.array([ids.get(w, 0) for w in ws], dtype="int32") for ws in folded]
        ends = np.cumsum([len(t) for t in texts], dtype="int64")
        starts = ends - [len(t) for t in texts]
        text = np.concatenate(texts) if texts else np.empty(0, dtype="int32")
        found = self.candidates(text, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
        if not len(found):
            return []
        stretches = self.stretches(found)
        passing = stretches[self.in_band(text, starts, ends, stretches) >= p.least]
        # the whole item around each stretch that passed
        length = np.array([len(t) for t in self.texts])
        at, diagonal = passing[:, 2:4], passing[:, 4:6]
        low = np.maximum(starts[passing[:, 0]], np.minimum(diagonal[:, 0], at[:, 0]) - length[passing[:, 1]] // 2 - p.window)
        high = np.minimum(ends[passing[:, 0]], np.maximum(diagonal[:, 1] + length[passing[:, 1]], at[:, 1]) + length[passing[:, 1]] // 2 + p.window)
        best: dict[tuple[int, int], int] = {}
        for some in in_chunks(high - low):
            rows = in_a_row([text[low[i] : high[i]] for i in some], [self.texts[passing[i, 1]] for i in some])
            for i, n in zip(some, rows.tolist()):
                key = (int(passing[i, 0]), int(passing[i, 1]))
                best[key] = max(n, best.get(key, 0))
        return [(d, item, n) for (d, i), n in best.items() if n >= p.least for item in self.same[i]]

    def stretches(self, found: np.ndarray) -> np.ndarray:
        """[doc, item text, first and last place, least and greatest diagonal]: shared windows near each other on near diagonals."""
        p = self.params
        diagonal = found[:, 2] - found[:, 3]
        lane = diagonal // p.window
        order = np.lexsort((found[:, 2], lane, found[:, 1], found[:, 0]))
        rows, diagonal, lane = found[order], diagonal[order], lane[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]) | (lane[1:] != lane[:-1]) | (rows[1:, 2] - rows[:-1, 2] > p.window)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(rows)) - 1
        return np.stack([rows[head, 0], rows[head, 1], rows[head, 2], rows[last, 2], np.minimum.reduceat(diagonal, head), np.maximum.reduceat(diagonal, head)], axis=1)

    def in_band(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, stretches: np.ndarray) -> np.ndarray:
        """For each stretch, the most matched words on a local alignment within the band around its diagonals."""
        p = self.params
        low = np.maximum(starts[stretches[:, 0]], stretches[:, 2] - p.reach)
        high = np.minimum(ends[stretches[:, 0]], stretches[:, 3] + p.window + p.reach)
        centre = (stretches[:, 4] + stretches[:, 5]) // 2
        wide = p.band + p.window // 2 + 1  # the diagonals of a stretch differ by less than a window
        most = np.zeros(len(stretches), dtype="int64")
        for some in in_chunks(high - low, 1024):
            m = int((high - low)[some].max())
            words, item = np.zeros((m, len(some)), dtype="int32"), np.full((m + 2 * wide, len(some)), -1, dtype="int32")
            for k, i in enumerate(some):
                words[: high[i] - low[i], k] = text[low[i] : high[i]]
                own = self.texts[stretches[i, 1]]
                first = int(low[i] - centre[i]) - wide  # the item's word at row 0
                a, b = max(0, first), min(len(own), first + m + 2 * wide)
                if a < b:
                    item[a - first : b - first, k] = own[a:b]
            dense = matched_densely(words, item, 2 * wide + 1, p.least)
            if len(dense):
                most[some[dense]] = banded(words[:, dense], item[:, dense], 2 * wide + 1)
        return most


def matched_densely(words: np.ndarray, item: np.ndarray, width: int, least: int) -> np.ndarray:
    """The pairs that may hold a row: some least * 3 / 2 words of the text of which ``least`` occur in the item next to them.

    The first ``least`` matches of a row come with fewer than half as many edits, so this leaves no row out.
    """
    near = np.stack([(item[i : i + width] == word).any(axis=0) for i, word in enumerate(words)]) & (words > 0)
    upto = np.concatenate([np.zeros((1, words.shape[1]), dtype="int32"), np.cumsum(near, axis=0, dtype="int32")])
    span = min(least + least // 2, len(words))
    return np.flatnonzero((upto[span:] - upto[:-span]).max(axis=0) >= least)


def in_chunks(sizes: np.ndarray, rows: int = 256, cells: int = 4_000_000) -> Iterator[np.ndarray]:
    """Numbers of all rows in chunks of like size, of so many rows and so many cells at most (or of one row)."""
    order = np.argsort(sizes, kind="stable")
    k = 0
    while k < len(order):
        end = min(k + rows, len(order))
        while end > k + 1 and (end - k) * int(sizes[order[end - 1]]) > cells:
            end = k + (end - k) // 2
        yield order[k:end]
        k = end


COST = 2


def banded(words: np.ndarray, item: np.ndarray, width: int) -> np.ndarray:
    """Local alignment as in ``in_a_row``, row by row of ``words`` [place, pair], against the ``width`` words of the item [place, pair] next to its diagonal."""
    c, kind = item.shape[1], np.int16 if len(words) < 30_000 else np.int32
    score, matched = np.zeros((width + 1, c), dtype=kind), np.zeros((width + 1, c), dtype=kind)  # the last row stays zero
    most, cost = np.zeros(c, dtype=kind), kind(COST)
    left, left_count = np.full((width, c), -cost, dtype=kind), np.zeros((width, c), dtype=kind)
    for i, word in enumerate(words):
        hit = item[i : i + width] == word
        diagonal, up = score[:-1] + hit * kind(1 + COST) - cost, score[1:] - cost
        new = np.maximum(diagonal, up)
        count = np.where(diagonal >= up, matched[:-1] + hit, matched[1:])
        left[1:], left_count[1:] = new[:-1] - cost, count[:-1]
        count = np.where(left > new, left_count, count)  # one word of the item left out
        new = np.maximum(new, left)
        live = new > 0
        np.multiply(new, live, out=score[:-1])
        np.multiply(count, live, out=matched[:-1])
        np.maximum(most, matched[:-1].max(axis=0), out=most)
    return most


def in_a_row(texts: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """For each pair, the most matched words on a local alignment: a match adds one, a changed, dropped or added word takes two.

    Several edits in a row so end the row soon, single ones do not.
    """
    c, n, m = len(texts), max(map(len, items), default=0), max(map(len, texts), default=0)
    item, text = np.full((c, n), -1, dtype="int32"), np.zeros((m, c), dtype="int32")
    step = np.int16 if n < 30_000 else np.int32
    for i, (t, x) in enumerate(zip(texts, items)):
        item[i, : len(x)], text[: len(t), i] = x, t
    cost = COST
    score, matched = np.zeros((c, n + 1), dtype=step), np.zeros((c, n + 1), dtype=step)
    zero = np.zeros((c, 1), dtype=step)
    most = np.zeros(c, dtype=step)
    gain, loss = step(1), step(-cost)
    for word in text:
        hit = item == word[:, None]
        diagonal = score[:, :-1] + np.where(hit, gain, loss)
        up = score[:, 1:] - cost
        new = np.maximum(diagonal, up)
        count = np.where(diagonal >= up, matched[:, :-1] + hit, matched[:, 1:])
        left, left_count = np.concatenate([zero, new[:, :-1]], axis=1) - cost, np.concatenate([zero, count[:, :-1]], axis=1)
        skip = left > new  # one word of the item left out
        new, count = np.where(skip, left, new), np.where(skip, left_count, count)
        live = new > 0
        score[:, 1:], matched[:, 1:] = new * live, count * live
        most = np.maximum(most, matched.max(axis=1))
    return most


def item_blocks(items: DataFrame, item: str, text: str, params: LeakParams) -> list[Index]:
    """The stated set of items in index blocks of bounded size."""
    rows = items.select(F.col(item).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t")
    ids, texts, first = [], [], []
    for r in rows.toLocalIterator():
        ids.append(r["i"])
        texts.append(words(r["t"]))
        first.append(words(re.split(r"(?<=[.!?:])\s", r["t"].strip(), maxsplit=1)[0]))
    texts = without_openings(texts, first, params.shared_openings)
    blocks, held, size = [], [], 0
    for i, w in zip(ids, texts):
        if held and size + len(w) > params.block_words:
            blocks.append(Index(held, params))
            held, size = [], 0
        if w:
            held.append((i, w))
            size += len(w)
    return [*blocks, Index(held, params)] if held else blocks


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", params: LeakParams = LeakParams()) -> DataFrame:
    """doc, item and words (the longest row of the item's words that the document holds).

    Null and empty texts hold and leak nothing; items of the same text leak together; repeated documents give equal rows
    once. The items are a stated set, read in blocks; a pass over the corpus tries several blocks on each text, folded once, and
    nothing is shuffled before the result.
    """
    spark: SparkSession = documents.sparkSession
    kinds = [documents.select(doc).schema[0].dataType.simpleString(), items.select(item).schema[0].dataType.simpleString()]
    rows = documents.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null and text is not null")
    rows = spread(rows)
    schema = f"doc {kinds[0]}, item {kinds[1]}, words int"

    def search(indices):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (piece for whole in batches for piece in in_pieces(whole, "text", 2_000_000)):
                docs = batch.column("doc").to_pylist()
                folded = [words(t) for t in batch.column("text").to_pylist()]
                found = [row for index in indices for row in index.value.leaks(folded)]
                out = ([docs[d] for d, _, _ in found], [i for _, i, _ in found], [n for _, _, n in found])
                types = [batch.schema.field("doc").type, pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["doc", "item", "words"])

        return run

    result = None
    blocks = item_blocks(items, item, text, params)
    for k in range(0, len(blocks), params.blocks_a_pass):
        part = rows.mapInArrow(search([spark.sparkContext.broadcast(b) for b in blocks[k : k + params.blocks_a_pass]]), schema)
        result = part if result is None else result.unionByName(part)
    if result is None:
        result = spark.createDataFrame([], schema)
    return result.groupBy("doc", "item").agg(F.max("words").alias("words")).withColumnsRenamed({"doc": doc, "item": item})
