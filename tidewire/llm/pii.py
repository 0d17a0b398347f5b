"""Personal information in free text: emails, phones, identity numbers, street addresses and names of people.

Regular expressions propose spans; validators (Luhn, mod-97 and the check digits of the label's own country) and the words
around a span move its score; spans at or over the threshold are kept, the surer kind winning where two overlap.

A number that bears no label stands on its check alone: payment cards, bank accounts and national numbers in their usual
grouping are found if the check passes and are nothing if it fails. Under a plain label (``tax id``, ``passport``) the label
confirms; under a word that is also an ordinary one (``nie``, ``rg``, ``inn``) without a colon, the check or the shape must.
Cards and bank accounts have kinds of their own.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.leakage import INVISIBLE
from tidewire.llm.tokens import TOKENIZERS, VOCABULARY, in_pieces
from tidewire.session import spread

KINDS = ("email", "id_number", "card", "iban", "phone", "address", "name")  # in the order in which they win
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}


@dataclass(frozen=True)
class PiiParams:
    """``before`` is how many characters before a span count as its context; ``given`` are further given names in lower case."""

    threshold: float = 0.65
    before: int = 48
    given: frozenset[str] = frozenset()
    validators: bool = True


# ---------------------------------------------------------------- validators


def luhn(digits: str) -> bool:
    """Card numbers and several national numbers."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return len(digits) > 1 and total % 10 == 0


def mod97(text: str) -> bool:
    """Bank account numbers: country and check digits moved to the end, letters as two digits, remainder one."""
    text = re.sub(r"\W", "", text).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{8,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def weighted(digits: str, weights: tuple[int, ...]) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights))


def snils(d: str) -> bool:
    return len(d) == 11 and weighted(d, tuple(range(9, 0, -1))) % 101 % 100 == int(d[9:])


def inn(d: str) -> bool:
    if len(d) == 10:
        return weighted(d, (2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == int(d[9])
    return len(d) == 12 and all(weighted(d, w) % 11 % 10 == int(d[len(w)]) for w in ((7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)))


def cpf(d: str) -> bool:
    return len(d) == 11 and all(weighted(d, tuple(range(n + 1, 1, -1))) * 10 % 11 % 10 == int(d[n]) for n in (9, 10))


def ssn(d: str) -> bool:
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def nir(d: str) -> bool:
    return len(d) == 15 and (int(d[:13]) + int(d[13:])) % 97 == 0


def dni(text: str) -> bool:
    m = re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", re.sub(r"\W", "", text).upper())
    return bool(m) and "TRWAGMYFPDXBNJZSQVHLCKE"[int({"": "", "X": "0", "Y": "1", "Z": "2"}[m[1]] + m[2]) % 23] == m[3]


def rnokpp(d: str) -> bool:
    return len(d) == 10 and weighted(d, (-1, 5, 7, 9, 4, 6, 10, 5, 7)) % 11 % 10 == int(d[9])


def steuer_id(d: str) -> bool:
    """Eleven digits with the public iterated check of modulus 11, 10."""
    if len(d) != 11 or d[0] == "0":
        return False
    product = 10
    for c in d[:10]:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(d[10])


def nif(d: str) -> bool:
    return len(d) == 9 and (11 - weighted(d, tuple(range(9, 1, -1))) % 11) % 11 % 10 == int(d[8])


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


def any_check(text: str) -> bool:
    d = digits_of(text)
    return luhn(d) or snils(d) or inn(d) or cpf(d) or ssn(d) or nir(d) or rnokpp(d) or steuer_id(d) or nif(d) or dni(text) or mod97(text)


#: The check that belongs to a label; labels of numbers without a public check (passports and the like) are absent.
OWN_CHECK: tuple[tuple[re.Pattern, Callable[[str], bool]], ...] = tuple(
    (re.compile(label, re.I), check)
    for label, check in (
        ("снилс", lambda t: snils(digits_of(t))), ("инн|inn", lambda t: inn(digits_of(t))), ("іпн|рнокпп", lambda t: rnokpp(digits_of(t))), ("ssn|social", lambda t: ssn(digits_of(t))),
        ("cpf", lambda t: cpf(digits_of(t))), ("steuer", lambda t: steuer_id(digits_of(t))), ("sécurité", lambda t: nir(digits_of(t))), ("dni|nie", dni), ("nif", lambda t: nif(digits_of(t)) or dni(t)),
        ("tax|fiscal|national|personal|identity|id card", any_check),
    )
)

#: Numbers that need no label if their check passes: kind, shape in the usual grouping, check.
BARE: tuple[tuple[str, re.Pattern, Callable[[str], bool]], ...] = (
    ("iban", re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\w])"), mod97),
    ("card", re.compile(r"(?<![\w.+-])(?:[2-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5})(?![\w]|[-.]\d)"), lambda t: luhn(digits_of(t))),
    ("id_number", re.compile(r"(?<![\w.+-])\d{3}-\d{3}-\d{3}[ -]\d{2}(?![\w]|[-.]\d)"), lambda t: snils(digits_of(t))),
    ("id_number", re.compile(r"(?<![\w.+-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w]|[-.]\d)"), lambda t: cpf(digits_of(t))),
    ("id_number", re.compile(r"(?<![\w.+-])\d{8}-?[A-Z](?![\w])"), dni),
    ("id_number", re.compile(r"(?<![\w.+-])[XYZ]\d{7}-?[A-Z](?![\w])"), dni),
)
#: Words that make a number of another kind out of what follows.
OTHER_NUMBER = re.compile(r"(?:order|isbn|ticket|build|version|uuid|invoice|post id|commit|sku|tracking|заказ\w*|заявк\w*|сборк\w*|верси\w*|id=)\W{0,4}(?:no\.?|number|№|#)?\W{0,3}$", re.I)


# ---------------------------------------------------------------- email

AT = r"(?:\s?[@＠]\s?|\s?[\[({<]\s?(?:at|@|собака|arroba)\s?[\])}>]\s?)"
AT_WORD = r"\s(?:at|собака|arroba|chez)\s"
DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|точка|крапка|punto|ponto|point)\s?[\])}>]\s?|\s(?:dot|точка|крапка)\s)"
DOT_WORD = r"(?:\s?[\[({<]\s?(?:dot|точка|крапка)\s?[\])}>]\s?|\s(?:dot|точка|крапка)\s)"
LOCAL = r"(?<![\w.+%@/-])[\w%][\w.+%-]*"
LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
EMAILS = (
    (re.compile(rf"{LOCAL}{AT}(?:{LABEL}{DOT})+[^\W\d_]{{2,24}}(?![\w@-])", re.I), 0.9),
    (re.compile(rf"{LOCAL}{AT_WORD}(?:{LABEL}\.)*{LABEL}(?:{DOT_WORD}{LABEL})*{DOT_WORD}[^\W\d_]{{2,24}}(?![\w@-])", re.I), 0.8),
)

#: What an address holds at its middle: a sign, or a word in brackets or between spaces; how far its two parts reach.
AT_SIGN = re.compile(r"[@＠]")
AT_ANY = re.compile(r"[@＠]|[\[({<]\s?(?:at|собака|arroba)", re.I)
AT_SPOKEN = re.compile(AT_WORD, re.I)
#: Small letters of which a text holds one if an address in it is written out.
AT_WORDS = (" at ", "\nat ", " at\n", "(at", "[at", "{at", "<at", "( at", "[ at", "{ at", "< at", "собака", "arroba", " chez ", "\tat", "\u00a0at", " at\t", " at\u00a0")
DOT_WORDS = ("dot", "точка", "крапка")
LOCAL_LENGTH, DOMAIN_LENGTH = 128, 320


def holds(*words: str) -> Callable[[str, str], bool]:
    """Whether a text in small letters holds one of the words, as every match of a pattern does."""

    def held(_: str, lowered: str) -> bool:
        for w in words:  # plainer than any(), and run on every text
            if w in lowered:
                return True
        return False

    return held


SPOKEN, DOTTED = holds(*AT_WORDS), holds(*DOT_WORDS)
DIGIT = re.compile(r"\d")

# ---------------------------------------------------------------- phone

PHONES = (
    (re.compile(r"(?<![\w+.])\+\d{1,3}[  .-]?(?:\(\d{1,4}\)[  .-]?)?\d(?:[  .-]?\d){5,11}(?![\w]|[-.]\d)"), 0.8),
    (re.compile(r"(?<![\w+.)-])\(\d{3,4}\)[  .-]?\d{3}[  .-]?\d{4}(?![\w]|[-.]\d)"), 0.75),
    (re.compile(r"(?<![\w+.-])\d{3}([.-])\d{3}\1\d{4}(?![\w]|[-.]\d)"), 0.7),
    (re.compile(r"(?<![\w+.,-])(?<!\d )0\d{2,4}[  /-]\d{3}[  -]?\d{3,5}(?![\w]|[-.,]\d| \d)"), 0.7),
    (re.compile(r"(?<![\w+.,-])(?<!\d )8[  -]?\(?\d{3}\)?[  -]?\d{3}[  -]?\d{2}[  -]?\d{2}(?![\w]|[-.,]\d| \d)"), 0.7),
    (re.compile(r"(?<![\w+.,-])(?<!\d )\d{2,4}(?:[  -]\d{2,4}){2,4}(?![\w]|[-.,]\d| \d)"), 0.2),
)
PHONE_NEAR = re.compile(r"(?:\btel|phone|\bcall|\bring\b|text me|mobile|whatsapp|звон|тел(?:ефон)?\b|телефон|моб\.|дзвон|телефонуйте|ruft|anruf|appel|llam|lig(?:uem|ue)|☎|📞)", re.I)
PHONE_AGAINST = re.compile(r"(?:order|isbn|ticket|build|version|price|uuid|invoice no|заказ|цена|заявк|\bssn|снилс|инн)\W{0,4}$", re.I)

# ---------------------------------------------------------------- identity number

ID_LABEL = (
    r"passport(?:\s(?:no\.?|number|nr\.?|№))?|паспорт(?:а|у|ом)?(?:\s(?:серия и номер|серії та номер|серія і номер|серія та номер|серии|серия|серія))?|"
    r"снилс|инн|inn|іпн|рнокпп|ssn|social security (?:number|no\.?)|tax (?:id|number|no\.?)|national (?:id|insurance)(?: number| no\.?)?|personal (?:id|number|code)|"
    r"id card (?:no\.?|number)|identity (?:card|number)|ausweis(?:nummer|-nr\.?)|personalausweis|reisepass(?:nummer)?(?:\snr\.?)?|steuer-?id(?:entifikationsnummer)?|steuernummer|"
    r"sozialversicherungsnummer|\bnie\b|\bnif\b|\bdni\b|\bcpf\b|\brg\b|pasaporte|passaporte|cartão de cidadão|passeport|carte d['’]identité|numéro de sécurité sociale|"
    r"numéro fiscal|n(?:ú|u)mero de la seguridad social|егн|иин|пинфл"
)
IDS = re.compile(rf"(?<![\w-])(?:{ID_LABEL})(?![\w])[\s:=#№.,n°ºNnor-]{{0,10}}?(?<![^\W\d_])(?P<v>(?:[^\W\d_]{{1,3}}[\s-]?)?\d(?:[\s.\-/]?\d){{4,17}}(?:[\s-]?[^\W\d_](?![\w]))?)(?![\w])", re.I)

#: Labels that are ordinary words or short for something else too.
WEAK_LABEL = re.compile(r"(?:nie|nif|dni|rg|inn|personal code)", re.I)
#: Shapes that are hardly anything else than an identity number.
STRONG_SHAPE = re.compile(r"[^\W\d_]{1,2}\s?\d{6,8}-?[^\W\d_]?|\d{8}-?[^\W\d_]")

#: Five digits or more with single separators, which every identity number holds; its label and letters take under 90 characters.
LONG_NUMBER = re.compile(r"\d(?:[\s.\-/]?\d){4,}")
#: Seven digits in a row or in groups, which a number without a label holds.
LONG_RUN = re.compile(r"\d(?:[ .\-]?\d){6,}")
#: What every phone consists of, but for its first sign.
DIALLED = re.compile(r"\d[\d  .()/-]{5,}\d")

# ---------------------------------------------------------------- address

UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐÉĘĚĞĢĪĶŁŃŇŐŘŚŠŞŤŪŮŰŹŻŽА-ЯЁІЇЄҐ"
PROPER = rf"[{UP}][\w'’-]*"
HOUSE = r"\d{1,4}(?:[ -]?[a-zа-яіA-F](?![\w]))?(?:\s?(?:к|корп\.?|стр\.?|/)\s?\d{1,3})?(?![\w])"
#: What follows a house number within the same address: flat, floor, door.
UNIT = re.compile(r",?\s(?:(?:apt|flat|unit|suite|кв|квартира|оф|офис|app|appt|wohnung)\.?\s?\d{1,4}[a-z]?|\d{1,2}\.?[ºª°](?:\s(?:[a-z]|esq|dto|dir|frente))?\.?(?![\w]))", re.I)
EN_TYPE = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Row|Drive|Dr|Way|Place|Pl|Square|Sq|Boulevard|Blvd|Terrace|Close|Crescent|Grove|Gardens|STREET|ST|AVENUE|AVE|ROAD|LANE|COURT|ROW|DRIVE)"
SLAV_TYPE = r"(?i:улиц[аыеу]|ул\.|проспект[ае]?|просп\.|пр-т|пр-кт|пр\.|переул(?:ок|ка|ке)|пер\.|бульвар[ае]?|б-р|бул\.|набережн(?:ая|ой)|наб\.|шоссе|ш\.|площад[ьи]|пл\.|проезд|тупик|вулиц[яію]|вул\.|провул(?:ок|ку)|пров\.|площ[аі])"
SLAV_HOUSE = rf",?\s*(?i:дом\s|д\.\s?|будинок\s|буд\.\s?|б\.\s?|№\s?)?\s?{HOUSE}"
CYRILLIC = re.compile("[а-яё]", re.I)
#: What a text must hold, and the pattern.
ADDRESSES = (
    (holds("street", " st", "ave", "road", " rd", "lane", " ln", "court", " ct", " row", " dr", "way", "place", " pl", "square", " sq", "boulevard", "blvd", "terrace", "close", "crescent", "grove", "gardens"), re.compile(rf"(?<![\w.-])\d{{1,4}}[A-Za-z]?,?\s+(?:[NSEW]\.?\s+)?(?:{PROPER}\s+){{1,3}}{EN_TYPE}(?![\w])")),
    (lambda text, _: bool(CYRILLIC.search(text)), re.compile(rf"(?=[бвнпртушБВНПРТУШ])(?<![\w-]){SLAV_TYPE}\s?(?:{PROPER}|\d{{1,2}}-[а-яі]+)(?:\s+(?!(?:дом|буд)\b)[\w-]+){{0,2}}?{SLAV_HOUSE}")),
    (lambda text, _: bool(CYRILLIC.search(text)), re.compile(rf"(?<![\w-])[{UP}][\w-]+(?:ый|ий|ой|ая|яя|ое|ЫЙ|ИЙ|ОЙ|АЯ|а|ої)\s+{SLAV_TYPE}{SLAV_HOUSE}")),
    (holds("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ufer", "damm", "ring", "am ", "an de", "auf de", "in der", "im ", "zum ", "zur ", "unter den"), re.compile(rf"(?<![\w-])(?:[{UP}][\w-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring|STRASSE|STR\.|GASSE|WEG)|(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den)\s+{PROPER}\s+{PROPER})\s+{HOUSE}")),
    (holds("rue", "avenue", "av.", "boulevard", "bd", "chemin", "allée", "place", "impasse", "quai", "cours", "route", "square"), re.compile(rf"(?<![\w.-])\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-D]))?,?\s+(?i:rue|avenue|av\.|boulevard|bd|chemin|allée|place|impasse|quai|cours|route|square)\s+(?:(?i:de la|de l['’]|des|du|de|d['’]|l['’])\s*)?{PROPER}(?:[\s-]{PROPER}){{0,3}}")),
    (holds("calle", "c/", "avenida", "avda", "av.", "plaza", "paseo", "camino", "carrera", "ronda", "rua", "travessa", "praça", "alameda", "largo", "estrada", "via", "piazza", "corso"), re.compile(rf"(?<![\w-])(?i:calle|c/|avenida|avda\.?|av\.|plaza|paseo|camino|carrera|ronda|rua|travessa|praça|alameda|largo|estrada|via|viale|piazza|corso)\s*(?:(?i:de la|de los|de las|del|de|das|dos|da|do|della|dei)\s+)?{PROPER}(?:\s+(?:(?i:de|del|da|do|dos|das|la)\s+)?{PROPER}){{0,3}},?\s+(?i:n\.?\s?º\s?|nº\s?)?{HOUSE}")),
)
NOT_STREET = re.compile(r"\b(?:Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")

# ---------------------------------------------------------------- names

#: Frequent given names by script (fixed values); Cyrillic ones are inflected by rule, further ones are a parameter.
LATIN_GIVEN = (
    "ada ahmed aisha alexey ali amit amina ana andreas angela anna anita bruno camille carlos carmen chiara christian clara daniel david dmitry elena emma emily "
    "fatima felix fernando george giulia hans hassan helen hugo ibrahim igor ines inês ingrid ivan jack james jan jean jennifer joana joanna joão john jonas jorge jose josé joseph juan julia jurgen jürgen "
    "karen katarzyna kenji kevin klaus laura linda luc luca lucía luis lukas marco maria marie mark marlen martin mary michael miguel mira miriam mohammed monika natalia nikolai noemi odette olga olivia omar "
    "pablo patricia paul paulo pedro peter petra pierre piotr priya rachel ramon ramón ravi richard robert ruben sabine samuel sandra sara sarah sergei silas sofia sophie stefan susan svetlana thomas tiago tobias "
    "victor vladimir wei william yuki yusuf zoe zoé agnieszka alice anne barbara elizabeth eva hannah lisa margaret nina simon"
).split()
CYRILLIC_GIVEN = (
    "тимур варвара савелий глеб лия родион артём артем инга злата клим мира леся оксана остап тарас соломія назар "
    "иван алексей александр дмитрий сергей андрей михаил николай павел егор максим денис олег юрий анна мария елена ольга наталья татьяна "
    "ирина светлана дарья полина софия олександр андрій сергій олексій дмитро богдан ярослав олена наталія ірина катерина юлія "
    "виктор владимир евгений никита роман константин вера галина людмила марина надежда екатерина анастасия ксения маргарита"
).split()
FALLS = {"ий": "ий ия ию ием ии", "ей": "ей ея ею еем ее", "ай": "ай ая аю аем ае", "ій": "ій ія ію ієм ії ієві", "ия": "ия ии ию ией иею", "ія": "ія ії ію ією", "ья": "ья ьи ье ью ьей", "а": "а ы и е у ой ою і", "я": "я и е ю ей ею і ї", "о": "о а у ом ові", "": "|а|у|ом|е|ові|і"}


def inflected(name: str) -> list[str]:
    """Case forms of a Cyrillic given name."""
    end = next(e for e in FALLS if name.endswith(e))
    ends = FALLS[end].split("|") if not end else FALLS[end].split()
    forms = [name[: len(name) - len(end)] + e for e in ends]
    return [*forms, name[:-2] + "авлу" if name == "павел" else name]


GIVEN = frozenset([*LATIN_GIVEN, *(f for n in CYRILLIC_GIVEN for f in inflected(n))])
#: Usual endings of surnames: Slavic in all cases, Germanic, Nordic, Iberian, Italian, French and English ones.
SURNAME = re.compile(
    r"(?:[а-яёіїєґ’'-]{2,}(?:(?:ов|ев|ёв|ин|ын|їн)(?:а|у|ым|им|ом|е|ой|ою|ы|і|ым)?|(?:ськ|ск|цк|цьк)(?:ий|ого|ому|им|ом|ая|ой|ую|ою|ої|ій|а|у)|енк(?:о|а|у|ом|ові)|(?:чук|щук|юк|няк|як)(?:а|у|ом|ові)?)"
    r"|[a-zà-ÿ’'-]*(?:berg|burg|lund|mont|wick|eira|andez|[aeiou]nez|[aeiou]ez|owsk[iay]?|sson|sen|mann|stein|stad|bach|hardt|meier|ovich|ova|enko|ski|sky|ska|ford|shire|worth|ton|etti|ini|elli))",
    re.I,
)
#: Nouns that make a product of a given name: nothing else in a text tells such products from names (fixed values).
PRODUCT = frozenset("cluster server cursor lantern ledger socket falcon kernel parser queue pipeline orchard harbor beacon anvil router cache conf project cloud studio labs suite engine bot app db api bridge compass atlas comet forge gateway grid hub kit lens mesh nova pulse relay rocket shield shop spark stack stream tower vault workshop".split())
#: English surnames that are words of the language (fixed values).
WORD_SURNAMES = frozenset("baker bell bennett bishop black brown bush carpenter carter cook cooper cross day field fisher ford foster fox freeman gardner gray green hall hill hunter king knight law lane lee little long marshall mason miller moore page palmer parker perry porter power price reed rice rose sharp shepherd smith snow stone taylor turner walker ward west white wise wolf wood young".split())
NAME_NEAR = re.compile(r"(?:speaker|contact|posted by|invoice goes to|ask for|on file for|thanks to|author|dear|mr\.?|mrs\.?|ms\.?|dr\.?|signed|регистр|докладчик|доповідач|контакт|автор|спасибо|дякуємо|владелец|власник|ponente|vortrag|exposé|palestra|au nom de|em nome de|a nombre de|ausgestellt auf|von|\"name\": ?\"|—)\W{0,4}$", re.I)
#: A capitalised pair, and the cues after which it is a name though its given name is in no list.
PAIR = re.compile(rf"(?<![^\W])(?P<a>[{UP}][^\W\d_]+)[  \t]{{1,2}}(?P<b>[{UP}][^\W\d_]+(?:[’'-][^\W\d_]+)*)")
ADDRESSED = re.compile(r"\b(?:speaker|contact|posted by|ask for|author|dear|mr\.?|mrs\.?|ms\.?|dr\.?|signed|sincerely|regards|докладчик|контакт|автор|уважаем(?:ый|ая|ые))\W{1,3}\Z", re.I)
#: The words of which every such cue holds one.
ADDRESSING = frozenset("speaker contact posted ask author dear mr mrs ms dr signed sincerely regards докладчик контакт автор уважаемый уважаемая уважаемые".split())
TOKENS = re.compile(r"[^\W\d_]+")
#: What separates the fields of a record, in which a name stands in any case.
FIELD = ("|", ";", "<")
WORDS = re.compile(r"[^\W\d_](?:[’'-]?[^\W\d_])*")
INITIAL = re.compile(r"(?<![^\W_])[^\W\d_]\.")
GAP = re.compile(r"[  \t]{1,2}\Z")


def common_words(folder: str = TOKENIZERS, name: str = VOCABULARY) -> frozenset[str]:
    """Lower-case words that a public vocabulary holds whole, which names seldom are.

    Raises where the file is absent, cannot be read or holds no such word: without them names are missed and nothing would say so.
    """
    path = f"{folder}/{name}"
    try:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        words = frozenset(w for t in vocabulary if t[:1] == "Ġ" and len(w := t[1:]) > 2 and w.isascii() and w.isalpha() and w.islower())
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"{path} is no vocabulary: {e!r}") from e
    if not words:
        raise ValueError(f"{path} holds no common words")
    return words


def cased(a: str, b: str) -> bool:
    """Whether two words of a name are cased alike: both capitalised, both upper or both lower."""
    return (a[0].isupper() and b[0].isupper()) or (a.islower() and b.islower())


def around_names(text: str, lowered: str, present: frozenset[str]) -> list[tuple[int, int]]:
    """Stretches of a text around its given names and initials, wide enough for the words that make a name with them."""
    if len(lowered) != len(text):  # some letters change their number in small letters
        return [(0, len(text))] if present or INITIAL.search(text) else []
    spots = [m.start() for m in INITIAL.finditer(text)]
    for name in present:
        at, n = lowered.find(name), len(name)
        while at >= 0:
            if not (at and lowered[at - 1].isalpha()) and not lowered[at + n : at + n + 1].isalpha():
                spots.append(at)
            at = lowered.find(name, at + n)
    out: list[tuple[int, int]] = []
    for at in sorted(spots):
        low, high = max(0, at - 80), min(len(text), at + 160)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def names(text: str, lowered: str, params: PiiParams, common: frozenset[str]) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of given names or initials together with a surname, in either order.

    A listed given name counts most; a surname is known by its ending, or by being written like the given name and being
    no common word of the vocabulary; the words before move the score. After a form of address a capitalised pair of
    uncommon words is a name too.
    """
    given_names = GIVEN | params.given if params.given else GIVEN
    tokens = TOKENS.findall(lowered)
    rare = lambda word: bool(common) and len(word) > 2 and word not in common and word not in PRODUCT and word not in given_names
    if not ADDRESSING.isdisjoint(tokens):
        for m in PAIR.finditer(text):
            if rare(m["a"].lower()) and rare(m["b"].lower()) and ADDRESSED.search(text[max(0, m.start() - 16) : m.start()]):
                yield m.start("a"), m.end("b"), 0.7
    found = [(m.start(), m.end(), m.group()) for low, high in around_names(text, lowered, given_names.intersection(tokens)) for m in WORDS.finditer(text, low, high)]
    if not found:
        return
    low = [w.lower() for _, _, w in found]
    n = len(found)

    def follows(i: int, initial: bool) -> bool:
        """Whether word i + 1 comes right after word i (after a point, if i is an initial)."""
        if i + 1 >= n:
            return False
        gap = text[found[i][1] : found[i + 1][0]]
        if initial:
            return gap[:1] == "." and (gap == "." or bool(GAP.fullmatch(gap[1:])))
        return bool(GAP.fullmatch(gap)) or gap in (", ",)

    def plain(i: int) -> bool:
        return follows(i, False) and text[found[i][1]] != ","

    def uncommon(i: int) -> bool:
        return rare(low[i])

    def surname(i: int, before: int) -> float:
        """How much word i looks like a surname beside word ``before``."""
        word = found[i][2]
        capital = word[0].isupper()
        if len(word) < 3 or low[i] in PRODUCT or not cased(found[before][2], word):
            return -1.0
        if low[i] in given_names:  # two given names in a row need a cue
            return 0.1 if capital else -1.0
        latin = word[0] < "\u0250"
        if SURNAME.fullmatch(word):
            return 0.5 if capital else 0.4
        if capital and latin and (uncommon(i) or low[i] in WORD_SURNAMES):
            return 0.4
        return 0.1 if capital else 0.0

    def cue(at: int) -> float:
        return 0.25 if NAME_NEAR.search(text[max(0, at - params.before) : at]) else 0.0

    for i in [k for k, w in enumerate(low) if w in given_names or len(w) == 1]:
        start, stop, word = found[i]
        if start and text[start - 1] in "@#_/":
            continue
        given, initial = low[i] in given_names, len(word) == 1 and word.isalpha() and text[stop : stop + 1] == "."
        if not given and not initial:
            continue
        if initial and start and (text[start - 1].isalnum() or text[start - 1] in ".&'’"):
            continue
        # given or initial, optional initials, surname
        j, ok = i, follows(i, initial)
        while ok and j + 1 < n and len(found[j + 1][2]) == 1 and text[found[j + 1][1] : found[j + 1][1] + 1] == "." and j - i < 2:
            j += 1
            ok = follows(j, True)
        best: tuple[int, int, float] | None = None
        if ok and text[found[j][1]] != ",":
            last = surname(j + 1, i)
            if last >= 0:
                score = (0.4 if given else 0.25) + last + cue(start)
                if last == 0 and uncommon(j + 1) and len(low[j + 1]) > 4:  # small letters: the words around decide
                    after = text[found[j + 1][1] : found[j + 1][1] + 40].lower()
                    score += (0.15 if cue(start) else 0.0) + ((0.3 if given else 0.4) if low[j + 1] in after or after.lstrip()[:1] in FIELD else 0.0)
                if re.match(r"\s\d+\.\d", text[found[j + 1][1] : found[j + 1][1] + 8]):
                    score -= 0.5
                best = (start, found[j + 1][1], score)
        # surname first
        if i and follows(i - 1, False):
            first = surname(i - 1, i)
            before = found[i - 1][0]
            shaped, hint = bool(SURNAME.fullmatch(found[i - 1][2])), cue(before)
            after = text[stop : stop + 40].lower()
            told = given and plain(i - 1) and uncommon(i - 1) and len(low[i - 1]) > 3 and (hint > 0 or low[i - 1] in after or after.lstrip()[:1] in FIELD)
            if first >= 0 and not (before and text[before - 1] in "@#_/") and (plain(i - 1) or given):
                if shaped and (given or (found[i - 1][2][0].isupper() and len(found[i - 1][2]) > 3)) or told:
                    score = (0.8 if given else 0.7) + (0.15 if hint else 0.0)
                    if not best or score > best[2]:
                        best = (before, stop + 1 if initial else stop, score)
        if best and best[2] >= params.threshold - 1e-9:
            yield best


# ---------------------------------------------------------------- all kinds


def zones(text: str, core: re.Pattern, before: int, after: int) -> list[tuple[int, int]]:
    """The stretches in which a match that holds one of ``core`` and reaches at most so far to either side of it can lie.

    Stretches that could share a match are one, so searching them finds what searching the whole text would.
    """
    out: list[tuple[int, int]] = []
    n = len(text)
    for m in core.finditer(text):
        low, high = max(0, m.start() - before), min(n, m.end() + after)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def within(pattern: re.Pattern, text: str, where: list[tuple[int, int]]) -> Iterator[re.Match]:
    for low, high in where:
        yield from pattern.finditer(text, low, high)


def labelled(m: re.Match, params: PiiParams) -> float:
    """The score of a number under a label: its shape, how plain the label is, its own check."""
    value, label = m.group("v"), m.group()[: m.start("v") - m.start()]
    weak = bool(WEAK_LABEL.fullmatch(re.split(r"[^\w-]", label, maxsplit=1)[0] if not label.lower().startswith("personal code") else "personal code")) and not re.search(r"[:=#№º°]", label)
    score = 0.3 + (0.2 if weak else 0.4) + (0.1 if sum(c.isdecimal() for c in value) >= 6 else -0.1)
    if weak and STRONG_SHAPE.fullmatch(value):
        score += 0.2
    check = next((c for pattern, c in OWN_CHECK if pattern.search(label)), None)
    if check and params.validators:
        score += 0.2 if check(value) else -0.1
    return score


def proposals(text: str, params: PiiParams, common: frozenset[str]) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, score) of everything that may be personal information."""
    near: Callable[[int], str] = lambda at: text[max(0, at - params.before) : at]
    # each pattern is tried only where a text holds what all its matches must hold
    lowered = text.lower()
    spoken = SPOKEN(text, lowered)
    if spoken or "@" in text or "＠" in text:
        spots = zones(text, AT_ANY if spoken else AT_SIGN, LOCAL_LENGTH, DOMAIN_LENGTH)
        for m in within(EMAILS[0][0], text, spots) if spots else ():
            yield "email", m.start(), m.end(), EMAILS[0][1] - (0.6 if "://" in near(m.start())[-12:] else 0)
        if spoken and DOTTED(text, lowered):
            for m in within(EMAILS[1][0], text, zones(text, AT_SPOKEN, LOCAL_LENGTH, DOMAIN_LENGTH)):
                yield "email", m.start(), m.end(), EMAILS[1][1] - (0.6 if "://" in near(m.start())[-12:] else 0)
    if not DIGIT.search(text):
        yield from (("name", *found) for found in names(text, lowered, params, common))
        return
    numbers = zones(text, LONG_NUMBER, 90, 8)
    for m in within(IDS, text, numbers):
        yield "id_number", m.start("v"), m.end("v"), labelled(m, params)
    if numbers and params.validators:
        runs = zones(text, LONG_RUN, 26, 12)
        for kind, pattern, check in BARE if runs else ():
            for m in within(pattern, text, runs):
                score = 0.45 + (0.3 if check(m.group()) else -0.3) - (0.4 if OTHER_NUMBER.search(near(m.start())) else 0)
                yield kind, m.start(), m.end(), score
    dialled = zones(text, DIALLED, 6, 6)
    for pattern, score in PHONES if dialled else ():
        for m in within(pattern, text, dialled):
            digits = sum(c.isdecimal() for c in m.group())
            if not 7 <= digits <= 15:
                continue
            score_here = score + (0.3 if PHONE_NEAR.search(near(m.start())) else 0) - (0.5 if PHONE_AGAINST.search(near(m.start())) else 0)
            yield "phone", m.start(), m.end(), score_here - (0.2 if digits < 10 else 0)
    for wanted, pattern in ADDRESSES:
        if wanted(text, lowered):
            for m in pattern.finditer(text):
                unit = UNIT.match(text, m.end())
                yield "address", m.start(), unit.end() if unit else m.end(), 0.8 - (0.6 if NOT_STREET.search(m.group()) else 0)
    for start, stop, score in names(text, lowered, params, common):
        yield "name", start, stop, score


def fold(text: str) -> tuple[str, list[int] | None]:
    """Composed text without invisible characters and, if that moved anything, the original place of each character."""
    if text.isascii() or (unicodedata.is_normalized("NFC", text) and not INVISIBLE.search(text)):
        return text, None
    out, at, i, n = [], [], 0, len(text)
    while i < n:
        if INVISIBLE.match(text[i]):
            i += 1
            continue
        j = i + 1
        while j < n and unicodedata.combining(text[j]):
            j += 1
        piece = unicodedata.normalize("NFC", text[i:j])
        out.append(piece)
        at += [i] * len(piece)
        i = j
    return "".join(out), [*at, n]


def mentions(text: str | None, params: PiiParams = PiiParams(), common: frozenset[str] | None = None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the personal information of a text, in order and without overlap; positions in code points."""
    if not text:
        return []
    plain, at = fold(text)
    kept: list[tuple[str, int, int, float]] = []
    common = frozenset() if common is None else common
    sure = [p for p in proposals(plain, params, common) if p[3] >= params.threshold - 1e-9]
    taken = bytearray(len(plain))
    for kind, a, b, score in sorted(sure, key=lambda p: (KINDS.index(p[0]), -p[3], p[1] - p[2], p[1])):
        if any(taken[a:b]):
            continue
        taken[a:b] = b"\1" * (b - a)
        kept.append((kind, a, b, score))
    kept.sort(key=lambda p: p[1])
    return kept if at is None else [(k, at[a], at[b], s) for k, a, b, s in kept]


def redact(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with a typed placeholder for each mention and otherwise unchanged."""
    out, last = [], 0
    for kind, a, b, _ in found:
        out += [text[last:a], PLACEHOLDER[kind]]
        last = b
    return "".join([*out, text[last:]])


def find(documents: DataFrame, key: str = "doc_id", text: str = "text", params: PiiParams = PiiParams(), folder: str = TOKENIZERS) -> DataFrame:
    """key, mentions (kind, start_pos, stop_pos, score) and redacted text of each row; one pass, no shuffle.

    A null text has no mentions and stays null; repeated rows come out each; other columns are left out.
    """
    kind_of_key = documents.select(key).schema[0].dataType.simpleString()
    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    common = documents.sparkSession.sparkContext.broadcast(common_words(folder))  # of fixed size, under 20 thousand words
    item = pa.struct([("kind", pa.string()), ("start_pos", pa.int64()), ("stop_pos", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in in_pieces(whole, "text", 4_000_000)):
            texts = batch.column("text").to_pylist()
            found = [mentions(t, params, common.value) for t in texts]
            rows_out = [[{"kind": k, "start_pos": a, "stop_pos": b, "score": s} for k, a, b, s in f] for f in found]
            clean = [None if t is None else redact(t, f) for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows_out, pa.list_(item)), pa.array(clean, pa.string())], ["key", "mentions", "redacted"])

    schema = f"key {kind_of_key}, mentions array<struct<kind: string, start_pos: bigint, stop_pos: bigint, score: double>>, redacted string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
