"""Languages of texts and of their segments by a byte convolutional network.

The network (byte embedding, filters of several widths, max pooling, softmax) is trained in numpy on a bounded sample of
labelled texts. Texts are split into sentences without links, mentions, tags, code and short quoted or bracketed phrases; each
sentence is read whole, as fixed-length byte windows, and takes the language of least mean log loss over its windows.
Sentences that repeat (digits aside) within a worker are read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import spread

#: Two-letter code, three-letter codes and English name of languages that labels may name (fixed values).
LANGUAGES = (
    "ar ara arabic,bg bul bulgarian,be bel belarusian,ca cat catalan,cs ces cze czech,da dan danish,de deu ger german,el ell gre greek,"
    "en eng english,es spa spanish,et est estonian,fa fas per persian,fi fin finnish,fr fra fre french,he heb hebrew,hi hin hindi,"
    "hr hrv croatian,hu hun hungarian,id ind indonesian,it ita italian,ja jpn japanese,ka kat geo georgian,kk kaz kazakh,ko kor korean,"
    "lt lit lithuanian,lv lav latvian,nl nld dut dutch,no nor norwegian,pl pol polish,pt por portuguese,ro ron rum romanian,ru rus russian,"
    "sk slk slo slovak,sl slv slovenian,sr srp serbian,sv swe swedish,th tha thai,tr tur turkish,uk ukr ukrainian,uz uzb uzbek,vi vie vietnamese,zh zho chi chinese"
)
SPELLINGS = {name: names.split()[0] for names in LANGUAGES.split(",") for name in names.split()}
UNKNOWN = ("", "und", "unknown", "none", "null", "mul", "zxx")

FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
JUNK = re.compile(r"</?[a-zA-Z][^<>\n]*>|`[^`\n]*`|\b(?:https?|ftp|tg)://\S+|\bwww\.\S+|\S+@\S+|[@#][\w/]+|[“«„][^”»“\n]{0,200}[”»“]|\([^()\n]{0,200}\)|\*\*|__|~~")
#: A quoted or bracketed stretch of so many words is a sentence of its own and stays.
PHRASE = 6
#: Signs of code, of which a line needs two, and one for every five words; a lone dollar or semicolon is prose.
CODE = re.compile(r"[={}\\~<>|]|(?<![\w-])--?[A-Za-z]|\w\(|::|\w\.\w+\(|;\s*$|\$[A-Za-z_{(]|[A-Za-z]:\d")
BREAK = re.compile(r"(?<=[.!?…؟۔।])\s+|(?<=[。！？])\s*|\n+")
#: Scripts written without spaces: their letters count, two for a word.
UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿]")
LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")
TAG = re.compile(r"^\s*(?:>\s*)*(?:[-–—•*]\s*)?\[[A-Za-z-]{2,7}\]\s*")
SIGNS = re.compile(r"^[^\w¿¡—–,:-]+")


@dataclass(frozen=True)
class NetParams:
    """``sample`` bounds the labelled rows that the network is fitted on, ``windows`` their windows.

    A language under ``share`` of the sample is a class only if its texts resemble each other more than they do another
    class; at least ``least`` rows make a class.
    """

    length: int = 96
    embed: int = 8
    widths: tuple[int, ...] = (3, 4, 5)
    filters: int = 28
    sample: int = 8_000
    windows: int = 21_000
    share: float = 0.01
    least: int = 3
    epochs: int = 9
    batch: int = 128
    rate: float = 3e-3
    seed: int = 7
    confident: float = 0.7


def word_count(piece: str) -> int:
    """Words of a piece; in scripts without spaces two letters count as one."""
    if piece.isascii():
        return len(LETTERS.findall(piece))
    unspaced = len(UNSPACED.findall(piece))
    return len(LETTERS.findall(UNSPACED.sub(" ", piece) if unspaced else piece)) + unspaced // 2


def is_code(piece: str, words: int) -> bool:
    signs = len(CODE.findall(piece))
    return signs >= 2 and 5 * signs >= words


def is_sentence(piece: str) -> bool:
    """Three words or more, begun like a sentence (not by a small letter); what begins otherwise (or after a dash) needs six."""
    n = word_count(piece)
    if n < 3 or is_code(piece, n):
        return False
    if n >= PHRASE:
        return True
    start = piece.lstrip(" \t>*#•·.0123456789)")
    if start[:1] in "—–-,:":
        return False
    first = LETTERS.search(start)
    return bool(first) and not first.group()[0].islower()


def blank(m: re.Match) -> str:
    """As many spaces as the match has characters; a long quoted or bracketed stretch stays."""
    piece = m.group()
    if piece[0] in "“«„(" and word_count(piece) >= PHRASE:
        return piece
    return " " * len(piece)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, cleaned) of the full sentences of a text; positions are in characters of the text."""
    if "```" in text:
        text = FENCE.sub(blank, text)
    clean = JUNK.sub(blank, text)
    out, at = [], 0
    for m in [*BREAK.finditer(clean), None]:
        end = m.start() if m else len(clean)
        piece = clean[at:end]
        cut = SIGNS.sub("", TAG.sub("", piece))
        if is_sentence(cut):
            lead = len(piece) - len(piece.lstrip())
            out.append((at + lead, at + len(piece.rstrip()), " ".join(cut.split())))
        at = m.end() if m else end
    return out


def windows(sentence: str, length: int) -> list[bytes]:
    """The sentence in lower case as byte windows that cover it; the last one ends where it ends."""
    raw = f" {sentence.lower()} ".encode("utf-8", "replace")
    if len(raw) <= length:
        return [raw.ljust(length, b"\0")]
    return [raw[i : i + length] for i in [*range(0, len(raw) - length, length), len(raw) - length]]


class ByteNet:
    """The network and its plain numpy training."""

    def __init__(self, classes: list[str], params: NetParams):
        rng = np.random.default_rng(params.seed)
        self.classes, self.params = classes, params
        wide, total = max(params.widths), params.filters * len(params.widths)
        f32 = lambda *s: rng.standard_normal(s).astype("float32")
        self.embed = f32(256, params.embed) * 0.5
        self.embed[0] = 0
        self.mask = np.concatenate([np.repeat(np.arange(wide) < w, params.embed)[:, None] * np.ones((1, params.filters)) for w in params.widths], axis=1).astype("float32")
        self.conv = f32(wide * params.embed, total) * self.mask / np.sqrt(wide * params.embed / 2)
        self.bias, self.out, self.top = np.zeros(total, "float32"), f32(total, len(classes)) * 0.1, np.zeros(len(classes), "float32")

    def save(self, path: str) -> None:
        """Keep the weights in a file, to read texts of later days without a new fit."""
        with open(path, "wb") as f:
            np.savez(f, classes=np.array(self.classes), **{n: getattr(self, n) for n in ("embed", "conv", "bias", "out", "top")})

    @classmethod
    def load(cls, path: str, params: NetParams) -> ByteNet:
        with np.load(path) as kept:
            net = cls([str(c) for c in kept["classes"]], params)
            for n in ("embed", "conv", "bias", "out", "top"):
                setattr(net, n, kept[n])
        return net

    def columns(self, x: np.ndarray) -> np.ndarray:
        wide = max(self.params.widths)
        e = self.embed[x]
        view = np.lib.stride_tricks.sliding_window_view(e, wide, axis=1)  # n, positions, embed, wide
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), -1, wide * self.params.embed)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities [n, class]."""
        out = []
        for i in range(0, len(x), 256):
            c = self.columns(x[i : i + 256])
            h = (c.reshape(-1, c.shape[2]) @ self.conv).reshape(*c.shape[:2], -1).max(axis=1)
            z = np.maximum(h + self.bias, 0) @ self.out + self.top
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.empty((0, len(self.classes)), "float32")

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int) -> None:
        p, rng = self.params, np.random.default_rng(self.params.seed + 1)
        names = ("embed", "conv", "bias", "out", "top")
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        step, total = 0, epochs * -(-len(x) // p.batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), p.batch):
                step += 1
                grads = self.gradients(x[order[i : i + p.batch]], y[order[i : i + p.batch]])
                rate = p.rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for n, g in zip(names, grads):
                    first[n] += 0.1 * (g - first[n])
                    second[n] += 0.001 * (g * g - second[n])
                    setattr(self, n, (getattr(self, n) - rate * first[n] / (np.sqrt(second[n]) + 1e-7)).astype("float32"))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        n, wide, d = len(x), max(self.params.widths), self.params.embed
        c = self.columns(x)
        h = (c.reshape(-1, c.shape[2]) @ self.conv).reshape(n, c.shape[1], -1)
        at = h.argmax(axis=1)  # n, filters
        pooled = np.take_along_axis(h, at[:, None, :], axis=1)[:, 0] + self.bias
        live = np.maximum(pooled, 0)
        z = live @ self.out + self.top
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), y] -= 1
        z /= n
        back = (z @ self.out.T) * (pooled > 0)
        seen = c[np.arange(n)[:, None], at]  # n, filters, wide * embed
        conv = np.einsum("nf,nfk->kf", back, seen, optimize=True) * self.mask
        ids = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(wide)]  # n, filters, wide
        into = back[:, :, None, None] * self.conv.T.reshape(1, -1, wide, d)
        flat = ids.ravel()
        embed = np.stack([np.bincount(flat, weights=into[..., k].ravel(), minlength=256) for k in range(d)], axis=1).astype("float32")
        embed[0] = 0
        return embed, conv, back.sum(axis=0), live.T @ z, z.sum(axis=0)


def as_bytes(rows: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, length)


TRIGRAMS = 16_384
#: How much nearer to its own label than to the next language a text of a rare language must lie.
MARGIN = 1.06


def profile(text: str) -> np.ndarray:
    """Hashed character trigrams of the sentences of a text, damped, of length one."""
    raw = np.frombuffer(" ".join(DIGITS.sub("0", s).lower() for _, _, s in sentences(text)).encode("utf-32-le", "replace"), dtype=np.uint32).astype("int64")
    if len(raw) < 3:
        return np.zeros(TRIGRAMS, "float32")
    out = np.sqrt(np.bincount((raw[:-2] * 1_000_003 + raw[1:-1] * 10_007 + raw[2:]) % 1_000_033 % TRIGRAMS, minlength=TRIGRAMS))
    return (out / np.linalg.norm(out)).astype("float32")


def supported(texts: list[str], labels: list[str], params: NetParams, counts: dict[str, int] | None = None) -> list[str]:
    """The languages that are classes: those with their share of all labels, and rarer ones whose texts belong together.

    Texts of a rare language that is one lie nearer to the others of its label than to those of any language taken so far;
    texts that only bear a wrong label do not. At least half of the rare label's texts must be of the first kind. ``counts``
    are the labels of the whole table, where the sample does not keep their shares.
    """
    held: dict[str, int] = {}
    for label in labels:
        held[label] = held.get(label, 0) + 1
    counts = counts or held
    order = sorted((c for c, n in held.items() if n >= params.least), key=lambda c: (-counts.get(c, 0), c))
    total = sum(counts.values())
    sums = {c: np.zeros(TRIGRAMS, "float32") for c in order}
    rare: dict[str, list[np.ndarray]] = {c: [] for c in order if counts.get(c, 0) < params.share * total}
    for text, label in zip(texts, labels):
        if label in sums:
            v = profile(text)
            sums[label] += v
            if label in rare and v.any():
                rare[label].append(v)
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    kept = [c for c in order if c not in rare]
    for c in (c for c in order if c in rare):
        others = np.stack([unit(sums[x]) for x in kept]) if kept else np.zeros((1, TRIGRAMS), "float32")
        own = sum(v @ unit(sums[c] - v) > MARGIN * (others @ v).max() for v in rare[c])
        if len(rare[c]) >= params.least and 2 * own >= len(rare[c]):
            kept.append(c)
    return sorted(kept)


def train(texts: list[str], labels: list[str], params: NetParams = NetParams(), counts: dict[str, int] | None = None) -> ByteNet:
    """Fit on the sentences of labelled texts, drop the windows whose label the first fit contradicts, and fit again."""
    classes = supported(texts, labels, params, counts) or ["und"]
    where = {c: i for i, c in enumerate(classes)}
    rows, y = [], []
    for text, label in zip(texts, labels):
        if label in where:
            for _, _, s in sentences(text):
                w = windows(DIGITS.sub("0", s), params.length)
                rows += w
                y += [where[label]] * len(w)
    net = ByteNet(classes, params)
    if not rows:
        return net
    x, target = as_bytes(rows, params.length), np.array(y)
    rng = np.random.default_rng(params.seed)
    each = [rng.permutation(np.flatnonzero(target == k)) for k in range(len(classes))]
    keep = np.concatenate([np.resize(own, max(1, params.windows // len(classes))) for own in each if len(own)])  # classes alike, small ones repeated
    x, target = x[keep], target[keep]
    net.fit(x, target, max(1, params.epochs // 3))
    agrees = net.scores(x).argmax(axis=1) == target
    if agrees.sum() > len(x) // 2:
        x, target = x[agrees], target[agrees]
    net.fit(x, target, params.epochs)
    return net


class Reader:
    """A worker's network and its bounded memory of sentences."""

    def __init__(self, net: ByteNet, remembered: int = 150_000):
        self.net, self.remembered, self.known = net, remembered, {}

    def learn(self, fresh: list[str]) -> None:
        rows, owner = [], []
        for i, s in enumerate(fresh):
            w = windows(s, self.net.params.length)
            rows += w
            owner += [i] * len(w)
        scores = self.net.scores(as_bytes(rows, self.net.params.length))
        owner = np.array(owner)
        total = np.zeros((len(fresh), scores.shape[1]))
        np.add.at(total, owner, scores)
        total /= np.bincount(owner, minlength=len(fresh))[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for s, k, q in zip(fresh, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
            self.known[s] = (self.net.classes[k], q)

    def read(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, language, confidence) of each sentence of each text."""
        split = [[(a, b, DIGITS.sub("0", s)) for a, b, s in sentences(t)] if t else [] for t in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        fresh = sorted({s for rows in split for _, _, s in rows} - self.known.keys())
        for i in range(0, len(fresh), 4096):
            self.learn(fresh[i : i + 4096])
        return [[(a, b, *self.known[s]) for a, b, s in rows] for rows in split]


def segments(read: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Neighbouring sentences of one language as one segment, with their mean confidence by length."""
    out: list[list] = []
    for a, b, lang, p in read:
        n = max(1, b - a)
        if out and out[-1][2] == lang:
            out[-1][1], out[-1][3], out[-1][4] = b, out[-1][3] + p * n, out[-1][4] + n
        else:
            out.append([a, b, lang, p * n, n])
    return [(a, b, lang, p / n) for a, b, lang, p, n in out]


def label_names(label: Column) -> Column:
    """The sorted two-letter codes that a label names; null where it names none. Unknown spellings stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    parts = F.transform(F.split(F.lower(label), r"\s*[,;+/|&]\s*"), lambda x: F.regexp_replace(F.trim(x), r"[-_][a-z]{2,4}$", ""))
    known = F.transform(F.filter(parts, lambda x: ~x.isin(*UNKNOWN)), lambda x: F.coalesce(F.element_at(table, x), x))
    names = F.array_sort(F.array_distinct(known))
    return F.when(F.size(names) > 0, names)


def messages(raw: DataFrame) -> DataFrame:
    """channel_id, msg_id and text of the posts among raw messages, still with repeated fetches."""
    p = F.from_json("payload", "`_` string, message string")
    rows = raw.select("channel_id", "msg_id", p.alias("p")).where("p._ = 'Message' and channel_id is not null and msg_id is not null")
    return rows.select("channel_id", "msg_id", F.col("p.message").alias("text"))


def texts_once(raw: DataFrame, posts: DataFrame) -> DataFrame:
    """channel_id, msg_id, text of messages and posts, one text a key; rows without a full key keep each text."""
    rows = messages(raw).unionByName(posts.select("channel_id", "msg_id", F.col("text").cast("string").alias("text"))).where("text is not null")
    own = F.when(F.col("channel_id").isNull() | F.col("msg_id").isNull(), F.col("text")).alias("own")
    return rows.groupBy("channel_id", "msg_id", own).agg(F.max("text").alias("text")).drop("own")


def current_labels(labels: DataFrame) -> DataFrame:
    """channel_id, msg_id, names: the newest label of each message; of equally new ones the last in order."""
    last = labels.where("channel_id is not null and msg_id is not null").groupBy("channel_id", "msg_id").agg(F.max(F.struct("labelled_at", "lang")).alias("l"))
    return last.select("channel_id", "msg_id", label_names(F.col("l.lang")).alias("names"))


def fit_network(raw: DataFrame, labels: DataFrame, params: NetParams = NetParams()) -> ByteNet:
    """Fit on some ``params.sample`` messages whose label names one known language, as many of each language as there are.

    Each language has an even part of the sample; its messages are those whose keys hash under the rate that its number of
    labels asks for, so that a rare language is not lost among frequent ones. A message with several texts gives the greatest.
    """
    known = labels.where("lang is not null and channel_id is not null and msg_id is not null").select("channel_id", "msg_id", label_names(F.col("lang")).alias("names"))
    single = known.where(F.size("names") == 1).select("channel_id", "msg_id", F.get("names", F.lit(0)).alias("lang")).where(F.col("lang").isin(*set(SPELLINGS.values())))
    counts = {r["lang"]: r["n"] for r in single.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a known language
    if not counts:
        return train([], [], params)
    even, rest, rates = params.sample, len(counts), {}
    for lang, n in sorted(counts.items(), key=lambda x: x[1]):  # what a rare language leaves goes to the others
        take = min(n, even // rest)
        rates[lang], even, rest = take / n, even - take, rest - 1
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    h = F.xxhash64("channel_id", "msg_id")
    some = single.where(F.pmod(h, F.lit(1 << 30)) < rate * (1 << 30)).groupBy("channel_id", "msg_id").agg(F.min("lang").alias("lang")).limit(2 * params.sample)
    texts = messages(raw.join(F.broadcast(some), ["channel_id", "msg_id"], "left_semi")).join(F.broadcast(some), ["channel_id", "msg_id"]).where("text <> ''")
    once = texts.groupBy("channel_id", "msg_id", "lang").agg(F.max("text").alias("text"))
    rows = sorted((r["channel_id"], r["msg_id"], r["lang"], r["text"]) for r in once.collect())
    return train([t for *_, t in rows], [lang for _, _, lang, _ in rows], params, counts)


def read_texts(texts: DataFrame, keys: list[str], net: ByteNet, text: str = "text") -> DataFrame:
    """keys and segments (start, stop, lang, confidence) of each text; a text without a full sentence has none."""
    shared = texts.sparkSession.sparkContext.broadcast(net)  # of fixed size, some 50 KB
    rows = texts.select(*keys, F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    piece = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewire.llm.tokens import in_pieces

        reader = Reader(shared.value)
        for batch in (x for whole in batches for x in in_pieces(whole, "text", 8_000_000)):
            found = [segments(r) for r in reader.read(batch.column("text").to_pylist())]
            names = ("start", "stop", "lang", "confidence")
            out = pa.array([[dict(zip(names, s)) for s in rows] for rows in found], pa.list_(piece))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], out], [*keys, "segments"])

    return rows.mapInArrow(run, f"{kinds}, segments array<struct<start: int, stop: int, lang: string, confidence: double>>")


def languages(read: DataFrame, keys: list[str], params: NetParams = NetParams()) -> DataFrame:
    """keys and names: the sorted languages of the text's confident segments, or of its best one if none is confident."""
    sure = F.filter("segments", lambda s: s["confidence"] >= params.confident)
    best = F.array_max(F.transform("segments", lambda s: F.struct(s["confidence"], s["lang"])))["lang"]
    names = F.when((F.size(sure) == 0) & (F.size("segments") > 0), F.array(best)).otherwise(F.array_distinct(F.transform(sure, lambda s: s["lang"])))
    return read.select(*keys, F.array_sort(names).alias("names"))


def mislabelled(raw: DataFrame, labels: DataFrame, params: NetParams = NetParams(), net: ByteNet | None = None) -> DataFrame:
    """channel_id, msg_id, lang for each language of the posts whose label is missing or names other languages.

    Repeated fetches count once; texts without a full sentence (null, empty, links, emoji, digits) are no case. Texts are
    read where they lie; only keys and language names are shuffled to meet the labels.
    """
    net = net or fit_network(raw, labels, params)
    found = languages(read_texts(spread(messages(raw)), ["channel_id", "msg_id"], net), ["channel_id", "msg_id"], params)
    once = found.where(F.size("names") > 0).groupBy("channel_id", "msg_id").agg(F.max("names").alias("found"))
    joined = once.join(current_labels(labels), ["channel_id", "msg_id"], "left")
    return joined.where("not (names <=> found)").select("channel_id", "msg_id", F.explode("found").alias("lang"))
