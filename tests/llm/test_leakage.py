from __future__ import annotations

import numpy as np
import pytest

from tidewire.llm import leakage
from tidewire.llm.leakage import LeakParams, in_a_row, words

RNG = np.random.default_rng(4)
VOCABULARY = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
ITEMS = [(i, "Read this and answer. " + " ".join(RNG.choice(VOCABULARY, 50))) for i in range(12)] + [(20, "Read this and answer. x"), (21, None), (22, "")]
ITEMS.append((30, ITEMS[3][1]))


def quote(item, start, n):
    return " ".join(ITEMS[item][1].split()[4 + start : 4 + start + n])


FILLER = "nothing of interest stands here at all"
DOCS = [
    (1, f"{FILLER} {quote(0, 10, 18)} {FILLER}"),
    (2, f"{FILLER} {quote(1, 5, 8)} {FILLER}"),  # too short
    (3, " ".join(reversed(quote(2, 0, 40).split()))),  # other order
    (4, quote(3, 0, 30).upper().replace(" ", ",\n> ")),
    (5, " ".join(w if i % 8 else "changed" for i, w in enumerate(quote(4, 4, 36).split(), 1))),
    (6, " ".join(w for i, w in enumerate(quote(5, 4, 36).split(), 1) if i % 9)),
    (7, quote(6, 0, 20).replace("o", "о").replace("word", "wo­rd")),
    (8, "Read this and answer. " + FILLER),
    (9, None), (10, ""), (11, f"{quote(7, 0, 15)} {FILLER * 30} {quote(8, 20, 16)}"),
    (12, " ".join(f"{w} added" if i % 10 == 0 else w for i, w in enumerate(quote(9, 2, 32).split(), 1))),
    (13, f"<b>{quote(10, 0, 9)}</b> &amp; {quote(10, 9, 9)}"), (1, f"{FILLER} {quote(0, 10, 18)} {FILLER}"),
]
EXPECTED = [(1, 0), (4, 3), (4, 30), (5, 4), (6, 5), (7, 6), (11, 7), (11, 8), (12, 9), (13, 10)]


def test_finds_passages_and_only_those(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert rows(leakage.leaks(docs, items), "doc_id", "item_id") == EXPECTED
    small = leakage.leaks(docs, items, params=LeakParams(block_words=120, blocks_a_pass=2))  # several blocks
    assert rows(small, "doc_id", "item_id") == EXPECTED
    assert leakage.leaks(docs.limit(0), items).count() == 0
    assert leakage.leaks(docs, items.limit(0)).count() == 0


def plain(text, item, cost=2):
    """The alignment, cell by cell."""
    best, score, count = 0, [[0] * (len(item) + 1) for _ in range(len(text) + 1)], [[0] * (len(item) + 1) for _ in range(len(text) + 1)]
    for i, w in enumerate(text, 1):
        for j, v in enumerate(item, 1):
            hit = w == v and w != 0
            options = [(score[i - 1][j - 1] + (1 if hit else -cost), count[i - 1][j - 1] + hit), (score[i - 1][j] - cost, count[i - 1][j])]
            s, c = max(options, key=lambda o: o[0])
            if s > 0:
                score[i][j], count[i][j] = s, c
                best = max(best, c)
    return best


def test_alignment_is_at_least_the_plain_one():
    for _ in range(30):
        item = RNG.integers(1, 6, 20)
        text = np.concatenate([RNG.integers(0, 6, 5), item[3:15], RNG.integers(0, 6, 5)])
        (n,) = in_a_row([text], [item])
        assert 12 <= plain(text.tolist(), item.tolist()) <= n <= 20


def test_recall_of_hashing_against_every_alignment():
    items = [(i, words(t)[4:]) for i, t in ITEMS[:12]]
    index = leakage.Index(items, LeakParams())
    wanted = got = 0
    for k in range(150):
        i = int(RNG.integers(0, 12))
        passage = items[i][1][int(RNG.integers(0, 30)) :][: int(RNG.integers(16, 21))]
        passage = [w if RNG.random() > 0.06 else "zzz" for w in passage]
        ids = [index.ids.get(w, 0) for w in passage]
        if in_a_row([np.array(ids)], [index.texts[i]])[0] >= 13:
            wanted += 1
            got += any(item == i for _, item, _ in index.leaks([FILLER.split() + passage + FILLER.split()]))
    assert wanted > 60 and got >= 0.98 * wanted


def test_band_equals_the_whole_alignment():
    """Passages at any place, also at the borders of the text and of the item, with drift from added and dropped words."""
    items = [(i, words(t)[4:]) for i, t in ITEMS[:12]]
    index = leakage.Index(items, LeakParams())
    for k in range(120):
        i = int(RNG.integers(0, 12))
        passage = []
        for w in items[i][1][int(RNG.integers(0, 36)) :][: int(RNG.integers(10, 40))]:
            r = RNG.random()
            passage += [] if r < 0.03 else ["zzz"] if r < 0.06 else [w, "zzz"] if r < 0.09 else [w]
        text = FILLER.split() * int(RNG.integers(0, 3)) + passage + FILLER.split() * int(RNG.integers(0, 3))
        ids = np.array([index.ids.get(w, 0) for w in text], dtype="int32")
        found = index.candidates(ids, np.zeros(len(ids), dtype=int))
        found = found[found[:, 1] == i]
        if not len(found):
            continue
        best = int(index.in_band(ids, np.array([0]), np.array([len(ids)]), index.stretches(found)).max())
        whole = int(in_a_row([ids], [index.texts[i]])[0])
        assert (best >= 13) == (whole >= 13), (text, best, whole)
        assert dict(((i, n) for _, i, n in index.leaks([text]))).get(i, whole if whole < 13 else None) == whole


@pytest.mark.parametrize("edits", [0, 1, 2])
@pytest.mark.parametrize("length", [15, 20, 30])
def test_recall_by_length_and_edits(length, edits):
    """Passages of real length with words changed, dropped or added: all of those that an alignment of everything finds."""
    items = [(i, words(t)[4:]) for i, t in ITEMS[:12]]
    index = leakage.Index(items, LeakParams())
    wanted = got = 0
    for k in range(40):
        i = int(RNG.integers(0, 12))
        start = int(RNG.integers(0, 50 - length + 1))
        passage = list(items[i][1][start : start + length])
        for at in RNG.choice(length - 2, edits, replace=False) + 1 if edits else ():
            kind = RNG.integers(3)
            passage[at : at + 1] = ["zzz"] if kind == 0 else [] if kind == 1 else [passage[at], "zzz"]
        text = FILLER.split() + passage + FILLER.split()
        ids = np.array([index.ids.get(w, 0) for w in text])
        if in_a_row([ids], [index.texts[i]])[0] >= 13:
            wanted += 1
            got += any(item == i for _, item, _ in index.leaks([text]))
    assert wanted >= (0 if length - edits < 15 else 30) and got == wanted


def test_folding():
    assert words("СURI­OUS <b>сat</b> &amp; trans-\n lation ﬁne") == ["curious", "cat", "translation", "fine"]
    assert words("") == []
