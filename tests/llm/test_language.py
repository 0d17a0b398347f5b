from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pytest

from tidewire.llm import language
from tidewire.llm.language import NetParams, Reader, segments, sentences, train

PARTS = {
    "en": ("the new server", "our old team", "a young reader", "keeps all the logs", "wrote a short guide", "asks about the tests", "over the weekend", "without any help", "for the third time"),
    "ru": ("новый сервер", "наша команда", "один читатель", "хранит все журналы", "написал короткую статью", "спрашивает про тесты", "за выходные", "без всякой помощи", "уже третий раз"),
    "de": ("der neue Server", "unser altes Team", "eine junge Leserin", "behält alle Protokolle", "schrieb eine kurze Anleitung", "fragt nach den Tests", "am Wochenende", "ohne jede Hilfe", "schon zum dritten Mal"),
}


def sentence(lang, rng):
    p = PARTS[lang]
    s = f"{p[rng.integers(3)]} {p[3 + rng.integers(3)]} {p[6 + rng.integers(3)]}."
    return s[0].upper() + s[1:]


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(1)
    labels = [str(rng.choice(list(PARTS))) for _ in range(300)]
    texts = [" ".join(sentence(lang, rng) for _ in range(3)) for lang in labels]
    noisy = [lang if rng.random() > 0.08 else "en" for lang in labels]  # some labels are wrong
    return train(texts, noisy, NetParams(windows=1500, epochs=8))


def test_held_out_accuracy(net):
    rng = np.random.default_rng(99)
    labels = [str(rng.choice(list(PARTS))) for _ in range(300)]
    found = Reader(net).read([sentence(lang, rng) for lang in labels])
    assert np.mean([f[0][2] == lang for f, lang in zip(found, labels)]) > 0.98


def test_segments_and_positions(net):
    rng = np.random.default_rng(3)
    a, b = sentence("en", rng), sentence("ru", rng)
    text = f"🎉 {a} {a}\n> {b}\n@name #tag https://x.example\n```\nfor i in range(10):\n    print(i)\n```"
    got = segments(Reader(net).read([text])[0])
    assert [s[2] for s in got] == ["en", "ru"] and all(s[3] > 0.7 for s in got)
    assert text[got[1][0] : got[1][1]].endswith(b) and a in text[got[0][0] : got[0][1]]


@pytest.mark.parametrize("text", ["", "🎉 🎉", "@name", "№ 17 / 2026", "https://x.example/a-b", "release notes", ", senior backend engineer", "(zero downtime deploy)", "— CLOUD NATIVE, OPEN SOURCE.", "“cold start considered harmful”", "kubectl get pods -n demo", "curl -s http://127.0.0.1:9090/health"])
def test_no_sentence(text):
    assert sentences(text) == []


@pytest.mark.parametrize("text", [
    "We waited for hours; nobody came to open the door.", "It cost us about $5 and then we all went home.", "我们昨天在学校见面了。", "昨日は学校で友達に会いました。", "التقينا أمس في المدرسة",
    "נפגשנו אתמול בבית הספר.", "เราพบกันที่โรงเรียนเมื่อวานนี้", "He said (and all of us heard him say it) nothing.", "for all of us (and there were many) it was late", "print runs were small in those days",
])
def test_sentences_of_any_script_and_with_signs(text):
    assert len(sentences(text)) >= 1


def test_long_quotations_stay_and_short_ones_go():
    text = "Das Buch heißt «The long way home» und ist gut. «We have all been waiting here for hours»"
    (_, _, a), (_, _, b) = sentences(text)
    assert "long way" not in a and b.startswith("We have") or "We have all been waiting" in b


def test_unspaced_sentences_end_at_their_stop():
    assert [s for *_, s in sentences("我们昨天在学校见面了。今天天气很好我们去公园玩。")] == ["我们昨天在学校见面了。", "今天天气很好我们去公园玩。"]


@pytest.mark.parametrize("text", ["docker run --rm -p 80:80 demo/web:1.0", "SELECT count(*) FROM jobs WHERE state = 'late';", "let total = items.reduce((a, b) => a + b, 0);", "for i in range(10):", "pip install tinyqueue==0.1.0"])
def test_code_is_no_sentence(text):
    assert sentences(text) == []


def test_rare_languages_are_classes_and_wrong_labels_are_not():
    rng = np.random.default_rng(4)
    labels = ["en"] * 900 + ["de"] * 900 + ["ru"] * 6 + ["nl"] * 12
    true = ["en"] * 900 + ["de"] * 900 + ["ru"] * 6 + ["en", "de"] * 6
    texts = [" ".join(sentence(x, rng) for _ in range(3)) for x in true]
    assert language.supported(texts, labels, NetParams()) == ["de", "en", "ru"]


def test_saved_network_reads_alike(net, tmp_path):
    net.save(str(tmp_path / "net.npz"))
    again = language.ByteNet.load(str(tmp_path / "net.npz"), net.params)
    text = [sentence(x, np.random.default_rng(2)) for x in PARTS]
    assert Reader(again).read(text) == Reader(net).read(text)


@pytest.mark.parametrize("text", ["¿Qué os parece?", "Qu'en pensez-vous ?", "[FR] Qu'en pensez-vous ?", "СОХРАНИТЕ ПОСТ, ЧТОБЫ НЕ ПОТЕРЯТЬ."])
def test_short_sentences(text):
    assert len(sentences(text)) == 1


def test_mislabelled(spark, rows, net):
    rng = np.random.default_rng(5)
    at = datetime(2026, 1, 1)
    en, ru, de = (" ".join(sentence(x, rng) for _ in range(2)) for x in ("en", "ru", "de"))
    doc = lambda text, kind="Message": json.dumps({"_": kind, "message": text})
    texts = [en, ru, f"{en}\n\n{ru}", de, en, "", "🎉", en, f"{ru} {de}", en, en * 40]
    raw = [(1, i, doc(t), at, "x") for i, t in enumerate(texts)] + [(1, 4, doc(en), at, "x"), (1, 50, doc(en, "MessageService"), at, "x"), (1, 51, None, at, None), (None, 1, doc(en), at, None), (1, 52, "{", at, None)]
    labels = [(0, "English"), (1, "en"), (2, "RU+en_GB"), (3, None), (5, "en"), (7, "und"), (8, "de"), (9, "eng"), (9, "eng"), (10, " EN-us ")]
    r = spark.createDataFrame(raw, "channel_id bigint, msg_id bigint, payload string, fetched_at timestamp, text string")
    post = spark.createDataFrame([(1, m, lang, at) for m, lang in labels], "channel_id bigint, msg_id bigint, lang string, labelled_at timestamp")
    assert rows(language.mislabelled(r, post, net=net)) == [(1, 1, "ru"), (1, 3, "de"), (1, 4, "en"), (1, 7, "en"), (1, 8, "de"), (1, 8, "ru")]
    assert language.mislabelled(r.limit(0), post, net=net).count() == 0


def test_segments_of_messages_and_posts(spark, rows, net, tmp_path, monkeypatch):
    from tidewire.llm import queries

    rng = np.random.default_rng(8)
    at = datetime(2026, 1, 1)
    en, ru, de = (" ".join(sentence(x, rng) for _ in range(2)) for x in ("en", "ru", "de"))
    raw = [(1, i, json.dumps({"_": "Message", "message": t}), at) for i, t in enumerate([en, ru, "", en, ru])] + [(1, 0, json.dumps({"_": "Message", "message": en}), at), (1, 9, None, at)]
    spark.createDataFrame(raw, "channel_id bigint, msg_id bigint, payload string, fetched_at timestamp").write.parquet(str(tmp_path / "raw_messages.parquet"))
    spark.createDataFrame([(1, 0, en), (1, 0, en), (2, 5, de), (None, 1, de), (None, 1, ru), (2, 6, None)], "channel_id bigint, msg_id bigint, text string").write.parquet(str(tmp_path / "cited_posts.parquet"))
    spark.createDataFrame([], "channel_id bigint, msg_id bigint, lang string, labelled_at timestamp").write.parquet(str(tmp_path / "post_labels.parquet"))
    monkeypatch.setattr(language, "fit_network", lambda *_: net)
    got = queries.p4_segments(spark, str(tmp_path))
    assert rows(got, "channel_id", "msg_id", "lang") == [(1, 0, "en"), (1, 1, "ru"), (1, 3, "en"), (1, 4, "ru"), (2, 5, "de"), (None, 1, "de"), (None, 1, "ru")]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.ByteNet(["a", "b"], NetParams(length=12, embed=3, widths=(2, 3), filters=4))
    for n in ("embed", "conv", "bias", "out", "top"):
        setattr(net, n, getattr(net, n).astype("float64"))
    x, y = rng.integers(1, 20, (5, 12)).astype(np.uint8), rng.integers(0, 2, 5)
    loss = lambda: -net.scores(x)[np.arange(5), y].mean()
    for name, g in zip(("embed", "conv", "bias", "out", "top"), net.gradients(x, y)):
        w = getattr(net, name)
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in w.shape)
            if name == "embed" or (name == "conv" and not net.mask[at]):
                at = (int(x[0, 3]), 1) if name == "embed" else (0, at[1])
            keep = w[at]
            w[at] = keep + 1e-5
            up = loss()
            w[at] = keep - 1e-5
            down = loss()
            w[at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-3
