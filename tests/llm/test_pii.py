from __future__ import annotations

import unicodedata

import pytest

from tidewire.llm import pii

COMMON = pii.common_words()
CASES = [
    ("Send your CV to ada.gordenby+jobs@mail.tinyforge.invalid or call +49 30 23125 325.", [("email", "ada.gordenby"), ("phone", "+49")]),
    ("Questions to bruno_morlund(at)mail.tinyforge.example, or x.y at quietlabs dot test; z＠q-labs.example", [("email", "bruno_"), ("email", "x.y"), ("email", "z＠")]),
    ("Резюме ждёт a@b.test, телефон 8 000 195 67 19 или (691) 555 0142", [("email", "a@b"), ("phone", "8 000"), ("phone", "(691)")]),
    ("Паспорт № КЕ000822. СНИЛС 000-609-096 88, ИНН 000093377235.", [("id_number", "КЕ000"), ("id_number", "000-609"), ("id_number", "000093")]),
    ("NIE: X0083018-X. numéro de sécurité sociale : 0 99 81 00 825 159 40. Passport no. HG0074973 is here", [("id_number", "X0083"), ("id_number", "0 99"), ("id_number", "HG00")]),
    ("Our new office: 138 W. Saddler St, Apt 3B, Eastwick Bay.", [("address", "138 W.")]),
    ("Новый офис: Сосновый переулок, 113, кв. 4; ул.Кленовая 161; пр-т Радистов, 34к2.", [("address", "Сосновый"), ("address", "ул.Кл"), ("address", "пр-т")]),
    ("59, chemin des Tisserands / calle del Olmo, 28 / Av. dos Teares 122 / Am Alten Kanal 163b / Mühlenstr. 10", [("address", "59, c"), ("address", "calle"), ("address", "Av. d"), ("address", "Am Al"), ("address", "Mühl")]),
    ("Спасибо Родиону Миршанину за подсказку. Контакт: Варвара Л. Вертунцова.", [("name", "Родиону"), ("name", "Варвара")]),
    ("— N. Tolquiss\nPosted by Ödenby Inês. Speaker: PETRA DARSTAAD, ask for ramón havmerin", [("name", "N. T"), ("name", "Ödenby"), ("name", "PETRA"), ("name", "ramón")]),
]
NOTHING = [
    None, "", "   ", "Clara Cluster 2.47 and Ada Server 1.96 are out. #job Felix Cursor", "@ada_gordenby wrote #ada", "npm install left-shelf@1.4.2 and @scope/kit@2.0.31",
    "Order 4471-922-287 was shipped. ISBN 000-0-00-424738-0. Build 20264457.472 is green. Ticket 666-67-ABC", "10.0.12.75:8080 answers again 2026-04-14 12:12:28", "uuid 00000000-0000-4000-8000-976191854799",
    "An SSN has nine digits; never put one in a log.", "The Erlenweg project was archived. Our cluster Alder Row has 76 nodes.", "6 000 – 10 000 / month, remote, price 1 250 000, discount 49%", "942 538 views and counting",
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_mentions_and_starts(text, expected):
    got = pii.mentions(text, common=COMMON)
    assert [(k, text[a:b][: len(s)]) for (k, a, b, _), (_, s) in zip(got, expected)] == expected and len(got) == len(expected)


@pytest.mark.parametrize("text", NOTHING)
def test_what_only_looks_like_it(text):
    assert pii.mentions(text, common=COMMON) == []


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_positions_count_code_points_of_the_text_as_it_is(text, expected):
    loose = "🎉́ " + unicodedata.normalize("NFD", text)
    got = pii.mentions(loose, common=COMMON)
    assert [k for k, *_ in got] == [k for k, _ in expected]
    assert all(unicodedata.normalize("NFC", loose[a:]).startswith(s) for (_, a, _, _), (_, s) in zip(got, expected))


@pytest.mark.parametrize(("text", "name"), [
    ("Talk by Anna Smith today", "Anna Smith"), ("We met James Brown there", "James Brown"), ("Contact: Mary Johnson", "Mary Johnson"), ("Dear Ahmed Hassan, hello", "Ahmed Hassan"), ("contact Wei Zhang", "Wei Zhang"),
    ("Dear Sandra Kowalczyk", "Sandra Kowalczyk"), ("Speaker: Kwame Nkrumah", "Kwame Nkrumah"), ("Anna Müller wrote this", "Anna Müller"), ("Maria García said so", "Maria García"), ("Уважаемый Виктор Пелевин!", "Виктор Пелевин"),
])
def test_names_outside_any_test_table(text, name):
    if not COMMON:
        pytest.skip("no vocabulary here")
    assert [text[a:b] for k, a, b, _ in pii.mentions(text, common=COMMON)] == [name]


@pytest.mark.parametrize("text", ["contact Rapid Router", "author Open Source", "Petra Cluster is out", "Danke Petra", "a string of 20 30 40 50 60", "during 20 30 40 50 60"])
def test_capitalised_pairs_that_are_no_names(text):
    assert pii.mentions(text, common=COMMON) == []


DECIDED = [
    ("paid with 4111 1111 1111 1111 today", "card", "paid with 4111 1111 1111 1112 today"), ("to GB82 WEST 1234 5698 7654 32 please", "iban", "to GB82 WEST 1234 5698 7654 33 please"),
    ("сообщил 112-233-445 95 вчера", "id_number", "сообщил 112-233-445 96 вчера"), ("dele 529.982.247-25 e mais", "id_number", "dele 529.982.247-24 e mais"), ("holds 12345678Z since", "id_number", "holds 12345678A since"),
    ("INN 7707083893 here", "id_number", "INN 7707083894 here"), ("снилс 11223", None, "ssn 12345"),
]


@pytest.mark.parametrize(("valid", "kind", "broken"), DECIDED)
def test_checks_admit_and_reject(valid, kind, broken):
    kinds = lambda t, p=pii.PiiParams(): [k for k, *_ in pii.mentions(t, p)]
    assert kinds(valid) == ([kind] if kind else []) and kinds(broken) == []
    if kind:
        assert kinds(valid, pii.PiiParams(validators=False)) == []  # the check alone admits it


def test_plain_labels_lift_numbers_that_fail_their_check():
    for text in ("СНИЛС 000-609-096 88", "SSN 000-04-3342", "INN: 1234567890", "NIE: X0083018-X", "dni 00088129Z"):
        assert [k for k, *_ in pii.mentions(text)] == ["id_number"]
    assert pii.mentions("order no. 4111 1111 1111 1111") == [] and pii.mentions("nie 12345678") == []


def test_further_given_names_are_a_parameter():
    text = "We met Zebulon Walker"
    assert pii.mentions(text, common=COMMON) == []
    assert [text[a:b] for _, a, b, _ in pii.mentions(text, pii.PiiParams(given=frozenset({"zebulon"})), COMMON)] == ["Zebulon Walker"]


def test_validators():
    assert pii.rnokpp("3184710691") and not pii.rnokpp("3184710692") and pii.steuer_id("86095742719") and not pii.steuer_id("86095742718") and pii.nif("123456789") and not pii.nif("123456788")
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.snils("11223344595") and pii.inn("7707083893") and pii.cpf("52998224725") and pii.dni("12345678Z") and not pii.ssn("000123456")


def test_table(spark, rows):
    long = "filler words stand here. " * 4000 + "mail a@b.test"
    data = [(1, "mail a@b.test now", "k"), (2, None, None), (3, "", ""), (4, long, "k"), (1, "mail a@b.test now", "k")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, key string")
    out = {r["doc_id"]: (r["redacted"], [(m["kind"], m["start_pos"]) for m in r["mentions"]]) for r in pii.find(df).collect()}
    assert out[1] == ("mail [EMAIL] now", [("email", 5)]) and out[2] == (None, []) and out[3] == ("", [])
    assert out[4][1] == [("email", len(long) - 8)] and out[4][0].endswith("mail [EMAIL]")
    assert pii.find(df.limit(0)).count() == 0


def test_a_missing_or_broken_vocabulary_is_no_result(spark, tmp_path):
    df = spark.createDataFrame([(1, "Anna Smith wrote this")], "doc_id bigint, text string")
    with pytest.raises(FileNotFoundError):
        pii.find(df, folder=str(tmp_path))
    for text in ("", "{}", "[]", '{"model": {"vocab": null}}', '{"model": {"vocab": {}}}', '{"model": {"vocab": {"Zx": 1, "\\u0120Ab": 2}}}'):
        (tmp_path / pii.VOCABULARY).write_text(text)
        with pytest.raises(ValueError):
            pii.find(df, folder=str(tmp_path))
