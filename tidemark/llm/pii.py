"""Problem 1: personal information inside free text.

Method: anchor expansion. One Aho-Corasick pass finds anchors (at-signs and their spelled-out forms, digits,
identifier cues, street words, initials, given names, patronymic endings); at each anchor a local deterministic
parser expands to the left and right and validates the boundary. Text without an anchor costs one pass of the
automaton. Nothing is shuffled but the few found kinds.

Defined results: null text -> null text and an empty list; empty text -> itself; a text cut in mid-item yields the
item only if what is left of it still satisfies the definition. Spans never overlap: an earlier kind in KINDS wins.
"""

from __future__ import annotations

import functools

import ahocorasick
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_rows

KINDS = ("email", "ident", "phone", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "ident": "[ID]", "phone": "[PHONE]", "address": "[ADDRESS]", "name": "[NAME]"}

# ---- vocabulary: common given names; case forms come from _forms() ------------------------------------------------
GIVEN_RU = """Александр Алексей Анатолий Андрей Антон Аркадий Арсений Артём Богдан Борис Вадим Валентин Валерий Василий
Виктор Виталий Владимир Владислав Вячеслав Геннадий Георгий Герман Глеб Григорий Даниил Денис Дмитрий Евгений Егор Ефим
Захар Иван Игнат Игорь Илья Кирилл Константин Лев Леонид Макар Максим Марк Матвей Михаил Никита Николай Олег Павел Пётр
Прохор Родион Роман Руслан Савелий Семён Сергей Степан Тарас Тимофей Тихон Фёдор Филипп Эдуард Юрий Яков Ярослав
Александра Алина Алла Анастасия Анна Валентина Варвара Вера Виктория Галина Дарья Евгения Екатерина Елена Елизавета
Жанна Зинаида Зоя Инна Ирина Кира Клавдия Ксения Лариса Лидия Любовь Людмила Маргарита Марина Мария Надежда Наталья
Нина Оксана Ольга Полина Раиса Светлана София Таисия Тамара Татьяна Ульяна Юлия Яна""".split()
GIVEN_LATIN = """Adele Alice Anna Anton Arthur Bertha Carl Charles Clara Edwin Elise Emil Emma Ernst Felix Fritz Georg George
Greta Hans Helen Henri Henry Hugo Ilse Jack James Jean John Jules Karl Klara Laura Louis Louise Lucie Marcel Margaret Maria
Marie Martha Martin Mary Max Michel Nora Oskar Oscar Otto Paul Peter Pierre Robert Rosa Rudolf Sarah Sophie Thomas Tilda
Vera Victor Walter William Adam Agnes Albert Alexander Alfred Amelia Amy Andrew Angela Anthony Antoine Barbara Benjamin
Bernard Brian Camille Caroline Catherine Charlotte Christian Christine Christopher Claire Claude Daniel David Deborah Denis
Dietrich Dominique Donald Dorothy Edward Eleanor Elizabeth Emily Eric Erika Eva Florence Frank Franz Frederick Gerhard Gilbert
Grace Heinrich Hermann Ingrid Isabel Jacob Jacques Jane Jennifer Jessica Joan Johann Jonathan Joseph Josephine Julia Julie
Jürgen Katharina Kenneth Klaus Laurent Linda Lisa Ludwig Madeleine Marc Marguerite Mark Matthew Matthias Michael Nancy Nathalie
Nicole Olivier Pamela Patricia Patrick Pauline Philip Philippe Rachel Rebecca Renate Richard Ronald Ruth Samuel Sandra Sebastian
Simon Stefan Stephen Steven Susan Susanne Sylvie Thérèse Timothy Ursula Valérie Wilhelm Wolfgang Yves""".split()


def _forms(name: str) -> set[str]:
    """Case forms of a Russian given name, by its ending."""
    stem = {"Пётр": "Петр", "Павел": "Павл", "Лев": "Льв", "Любовь": "Любов"}.get(name, name)
    if name == "Любовь":
        return {"Любовь", "Любови", "Любовью"}
    if name.endswith("ия"):
        ends, stem = ("ия", "ии", "ию", "ией"), name[:-2]
    elif name.endswith("я"):
        ends, stem = ("я", "и", "е", "ю", "ей"), name[:-1]
    elif name.endswith("а"):
        ends, stem = ("а", "ы", "и", "е", "у", "ой"), name[:-1]
    elif name[-1] in "йь":
        ends, stem = (name[-1], "я", "ю", "ем", "е", "и"), name[:-1]
    else:
        ends = ("", "а", "у", "ом", "ем", "е")
    return {name} | {stem + e for e in ends if stem + e != "Петр"}


@functools.cache
def _given_forms() -> frozenset[str]:
    return frozenset(f.lower() for name in GIVEN_RU for f in _forms(name))


# ---- local parsers -----------------------------------------------------------------------------------------------
_RU_UP, _LOC = "А-ЯЁ", r"[^\W_][\w.+\-]*"
_DOMAIN = r"(?:[^\W_](?:[\w\-]*[^\W_])?\s?\.\s?)+[^\W\d_]{2,}"
_MAIL_LEFT = re.compile(r"(?<![\w.+\-])" + _LOC + r"\s?$")
_MAIL_RIGHT = re.compile(r"\s?((?:[^\W_](?:[\w\-]*[^\W_])?\.)+[^\W\d_]{2,})(?![\w])")

_PHONE = re.compile(
    r"""\+\d{1,3}[\s.\-]?\(?\d{2,4}\)?[\s.\-]?\d{2,5}(?:[\s.\-]\d{2,5}){0,3}(?!\d)
    | 00\d{1,3}[\s.\-]\d{6,8}(?!\d) | 00\d{1,3}[\s.\-]\d{2,4}(?:[\s.\-]\d{2,4}){1,3}(?!\d)
    | \+\d{10,13}(?!\d)
    | 8[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?![\d\-])
    | \(\d{3,5}\)\s?\d{2,3}[\s\-]\d{2}[\s\-]\d{2}(?![\d\-]) | \(\d{3,5}\)\s?\d{5,7}(?!\d)
    | \(?\d{3}\)?[\s.\-]\d{3}[\-.]\d{4}(?![\d\-]) | \d{3}-\d{2}-\d{2}(?![\d\-]) | 0\d{2,4}/\d{4,7}(?!\d)""",
    re.X,
)
_PHONE_SHORT = re.compile(r"\d{2}-\d{2}-\d{2}(?![\d\-])")
_PHONE_CUE = re.compile(r"(?i)(?:\bт\.|тел\.?|телефон\w*|номеру|звонить|связь:|контакт:?|диспетчер)\s*$")
_NOT_PHONE = re.compile(r"(?i)(?:№|изделия|\bту|\bгост|инвентарн\w+ номер|прибора|сч[её]т|накладная|\bарт\.)\s*$")
_SNILS = re.compile(r"\d{3}-\d{3}-\d{3}[\s\-]\d{2}(?![\d\-])")

_IDENT_TAIL = {
    "papers": re.compile(r"[^\d\n№]{0,32}?(?:№\s?)?(\d{2}[\s\-]?\d{2}(?:\s?№\s?|[\s\-])?\d{6})(?!\d)"),
    "snils": re.compile(r"[^\d\n]{0,16}?(\d{3}[\s\-]?\d{3}[\s\-]?\d{3}[\s\-]?\d{2})(?!\d)"),
    "inn": re.compile(r"[^\d\n]{0,12}?(\d{12})(?!\d)"),
    "latin": re.compile(r"[^\d\n]{0,24}?(?<![A-Za-z])([A-Z]{1,2}\s?\d{3}\s?\d{4}|[A-Z]{0,2}\d{7,9})(?!\d)"),
}
_IDENT_CUES = {
    "papers": ("паспорт", "пасп.", "водительск", "удостоверени", "в/у"),
    "snils": ("снилс", "страховой номер", "страхового номера", "страховым номером"),
    "inn": ("инн",),
    "latin": ("passport", "driving licen", "driver's licen", "permis de conduire", "passeport", "führerschein", "reisepass", "ausweis"),
}

_N = rf"[{_RU_UP}][\w\-]+"
_TYPE = r"(?:ул\.|улиц[аеыу]|пер\.|переул(?:ок|ке|ка)|пр-д|проезде?|просп\.|проспекте?|мкр\.?|микрорайоне?|шоссе|наб\.|набережн(?:ая|ой)|бульваре?|б-р|тупике?|алле[яе]|пл\.|площад[ьи])"
_HOUSE = r"(?:(?:д\.|дом[еа]?|№)\s?)?\d{1,4}[а-яА-Яa-z]?(?:\s?[/\-]\s?\d{1,4})?(?![\d%.:]\d|\d)"
_TOWN = rf"(?:(?:\d{{6}},?\s)?(?:г\.|город[еа]?|пос\.|пос[её]лок|с\.|дер\.|слобода)\s?{_N},\s|\d{{6}},\s)?"
_FLAT = r"(?:,?\s(?:корп|стр|кв|к|оф|строение|корпус|квартира)\.?\s?\d{1,4})*"
_ADDRESS_RU = re.compile(rf"(?i:{_TOWN.replace(_N, '[^,]{2,40}?')})(?:(?i:{_TYPE})\s?{_N}(?:\s{_N})?,?\s?(?i:{_HOUSE})|{_N}(?:\s{_N})?\s(?i:{_TYPE}),?\s?(?i:{_HOUSE}))(?i:{_FLAT})")
_ADDRESS_CORE = re.compile(rf"(?i:{_TYPE})\s?{_N}(?:\s{_N})?,?\s?(?i:{_HOUSE})|(?<!\w){_N}\s(?i:{_TYPE}),?\s?(?i:{_HOUSE})")
_ADDRESS_LATIN = re.compile(
    r"""(?:(?:Flat|Apt\.?|Unit)\s\d+,\s)?(?<![\w.,])\d{1,4}[a-z]?\s(?:[A-Z][\w']+\s){1,3}(?:Street|Lane|Walk|Road|Avenue|Row|Square|Close|Court|Drive|Way|St\.|Rd\.)(?!\w)
    | (?<!\w)[A-ZÄÖÜ][\wäöüß\-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm)\s\d{1,4}\s?[a-z]?(?!\w)
    | (?<![\w.,])\d{1,4}(?:\s(?:bis|ter))?,?\s(?:rue|impasse|quai|avenue|allée|chemin|place|boulevard|cours|passage|ruelle)\s(?:d[eu]s?\s|de\sla\s|de\sl['’]|d['’])?[A-ZÀ-Ý][\w\-]+""",
    re.X,
)

_PATRONYMIC = r"[А-ЯЁ][а-яё]+(?:(?:ович|евич|ьич)(?:а|у|ем|ом|е)?|(?:овн|евн|ичн)(?:а|ы|у|е|ой))(?!\w)|[А-ЯЁ]{2,}(?:(?:ОВИЧ|ЕВИЧ|ЬИЧ)(?:А|У|ЕМ|ОМ|Е)?|(?:ОВН|ЕВН|ИЧН)(?:А|Ы|У|Е|ОЙ))(?!\w)"
_SURNAME = r"(?i:\w+(?:(?:ов|ев|ёв|ин|ын)(?:а|у|ым|ой|е|ых|ыми)?|(?:ск|цк)(?:ий|ая|ого|ому|им|ом|ой|ую)|енко|(?:евич|ович)(?:а|у|ем|е)?|(?:[ую]к|ян|дзе|швили)(?:а|у|ом|е)?|[ыи]х))"
_IS_SURNAME = re.compile(_SURNAME)
_AFTER_PATR = re.compile(rf"\s({_PATRONYMIC})(?:\s([{_RU_UP}][\w\-]+))?")
_WORD_RIGHT = re.compile(r"\s?(\p{Lu}[\w\-]+)")
_WORD_LEFT = re.compile(r"(\p{Lu}[\w\-]+)(,?\s)$")
_PATR_LEFT = re.compile(rf"(?<!\w)([{_RU_UP}][\w\-]+)\s$")
_INITIALS = re.compile(r"\p{Lu}\.(?:\s?\p{Lu}\.)?(?![\w])?")
_LATIN_SUR = re.compile(r"\s(\p{Lu}[\p{L}'’\-]{2,})(?!\w)")
_LATIN_FIRM = re.compile(r"\s(?:&|and Co|et Cie|u\. Co|GmbH|Ltd)")
_FEMALE = re.compile(r"(?i)(?:овн|евн|ичн)\w{1,2}$")
_MALE_GIVEN = re.compile(r"(?:[бвгджзклмнпрстфхцчшщйь]|[аяуюе]|ем|ом|ым)$")
# Offices and forms of address that stand before a surname.
_OFFICES = frozenset(f"{w}{e}" for w in """агроном адвокат академик архивариус бригадир бухгалтер водитель врач генерал господин граждан гражданин губернатор дежурный
директор доктор завхоз заведующий инженер инспектор кандидат канцлер капитан князь кассир комендант контролёр куратор лейтенант майор мастер министр
начальник нотариус оператор отец пан печник писатель плательщик полковник помощник поэт председатель президент продавец профессор редактор ревизор секретарь слесарь
смотритель староста сержант сторож судья техник товарищ учитель фельдшер хранитель художник экспедитор""".split() for e in ("", "а", "у", "ом", "ем", "е", "я", "ю"))
_TITLES = frozenset("Mr Mrs Ms Herr Frau Mme Mlle M Monsieur Madame Fig Sec No St Nr Tab Abb".split())


def _window(text: str, i: int, n: int) -> str:
    return text[i - n if i > n else 0 : i]


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()

    def add(word: str, what: tuple) -> None:
        for w in {word, word.upper(), word[0].upper() + word[1:]}:
            if w not in a:
                a.add_word(w, (what[0], len(w), *what[1:]))

    for w in ("@", "＠", "(at)", "[at]", "{at}", "(собака)", "[собака]", " собака "):
        add(w, ("mail",))
    for d in "0123456789":
        a.add_word(d, ("num", 1))
    for what, cues in _IDENT_CUES.items():
        for w in cues:
            add(w, ("id", what))
    for w in ("ул.", "улиц", "пер.", "переул", "пр-д", "проезд", "просп", "мкр", "микрорайон", "шоссе", "наб.", "набережн", "бульвар", "б-р ", "тупик", "алле", "пл.", "площад"):
        add(w, ("street",))
    for w in (" Street", " Lane", " Walk", " Road", " Avenue", " Row", " Square", " Close", " Court", " Drive", " Way", " St.", " Rd.", "straße", "strasse", "str.", "gasse", "weg ", "platz ", "allee ", "ufer ", "damm ", "rue ", "impasse ", "quai ", "avenue ", "allée ", "chemin ", "place ", "boulevard ", "cours ", "passage ", "ruelle "):
        a.add_word(w, ("street_latin", len(w)))
    for base in GIVEN_RU:
        for f in _forms(base):
            for w in (f, f.upper()):
                a.add_word(w, ("given_ru", len(w)))
    for base in GIVEN_LATIN:
        for w in (base, base.upper()):
            a.add_word(w, ("given_latin", len(w)))
    female, male = (("овн", "евн", "ичн"), ("а", "ы", "у", "е", "ой")), (("ович", "евич", "ьич"), ("", "а", "у", "ем", "ом", "е"))
    for stems, ends in (female, male):
        for x in (w + e for w in stems for e in ends):
            for y in (x, x.upper()):
                a.add_word(y, ("patronymic", len(y)))
    for c in "АБВГДЕЁЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯABCDEFGHIJKLMNOPQRSTUVWXYZ":
        a.add_word(c + ".", ("initial", 2))
    a.make_automaton()
    return a


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of personal information in one text, ordered and disjoint."""
    if not text:
        return []
    got: list[tuple[int, int, str]] = []
    done_num = done_name = -1
    for end, (what, n, *more) in _automaton().iter(text):
        s, e = end - n + 1, end + 1
        if what == "num":
            if s < done_num:
                continue
            done_num = e
            while done_num < len(text) and text[done_num].isdigit():
                done_num += 1
            if s and text[s - 1] in "+(":
                s -= 1
                if s and text[s - 1] == "+":
                    s -= 1
            before = text[s - 1] if s else " "
            if before.isalnum() or before in "-/@" or before == "." and s > 1 and text[s - 2].isdigit():
                continue
            m = _SNILS.match(text, s)
            if m:
                got.append((s, m.end(), "ident"))
                done_num = m.end()
                continue
            m = _PHONE.match(text, s)
            if m and not _NOT_PHONE.search(_window(text, s, 24)):
                got.append((s, m.end(), "phone"))
                done_num = m.end()
            elif not m and _PHONE_SHORT.match(text, s) and _PHONE_CUE.search(_window(text, s, 14)):
                got.append((s, s + 8, "phone"))
                done_num = s + 8
        elif what == "initial":
            if s >= done_name and (name := _initials(text, s)):
                got.append((*name, "name"))
                done_name = name[1]
        elif what == "given_ru":
            if s >= done_name and _word(text, s, e) and (name := _given_ru(text, s, e)):
                got.append((*name, "name"))
                done_name = name[1]
        elif what == "patronymic":
            if s >= done_name and (e == len(text) or not text[e].isalnum()) and (name := _patronymic(text, s, e)):
                got.append((*name, "name"))
                done_name = name[1]
        elif what == "given_latin":
            if s >= done_name and _word(text, s, e) and (name := _given_latin(text, s, e)):
                got.append((*name, "name"))
                done_name = name[1]
        elif what == "mail":
            left = _MAIL_LEFT.search(_window(text, s, 80))
            right = _MAIL_RIGHT.match(text, e)
            if left and right and not left.group().strip().isdigit():
                got.append((s - len(left.group()), right.end(1), "email"))
        elif what == "id":
            m = _IDENT_TAIL[more[0]].match(text, e)
            if m and (not s or not text[s - 1].isalpha()):
                got.append((m.start(1), m.end(1), "ident"))
        elif what == "street":
            if s and text[s - 1].isalpha():
                continue
            w0 = max(0, s - 70)
            for m in _ADDRESS_CORE.finditer(text, max(0, s - 45), min(len(text), e + 60)):
                if m.start() <= s < m.end():
                    full = next((f for f in _ADDRESS_RU.finditer(text, w0, min(len(text), m.end() + 60)) if f.start() <= m.start() and f.end() >= m.end()), m)
                    got.append((full.start(), full.end(), "address"))
                    break
        elif what == "street_latin":
            for m in _ADDRESS_LATIN.finditer(text, max(0, s - 60), min(len(text), e + 40)):
                if m.start() <= s < m.end() or m.start() <= e - 1 < m.end():
                    got.append((m.start(), m.end(), "address"))
                    break
    return _disjoint(got) if len(got) > 1 else got


def _word(text: str, s: int, e: int) -> bool:
    return (not s or not (text[s - 1].isalnum() or text[s - 1] == "-")) and (e == len(text) or not text[e].isalnum())


def _surname(word: str) -> bool:
    return bool(_IS_SURNAME.fullmatch(word))


def _initials(text: str, s: int) -> tuple[int, int] | None:
    if s and not (text[s - 1].isspace() or text[s - 1] in "(«\"„"):
        return None
    m = _INITIALS.match(text, s)
    if not m:
        return None
    e, double = m.end(), m.group().count(".") == 2
    cyrillic = text[s] >= "Ѐ"
    right, left = _WORD_RIGHT.match(text, e), _WORD_LEFT.search(_window(text, s, 40))
    if right and text[e : e + 1].isspace() is False and not double and not text[e : e + 1].isalpha():
        right = None
    before = text[s - 2] if s > 1 else "."
    if cyrillic:
        if right and _surname(right.group(1)):
            return s, right.end(1)
        if left and _surname(left.group(1)) and "," not in left.group(2):
            return s - len(left.group()), e
        if double and right and len(right.group(1)) > 2 and not left:
            return s, right.end(1)
        if double and left and before not in ".!?" and "," not in left.group(2):
            return s - len(left.group()), e
        return None
    sur = _LATIN_SUR.match(text, e)
    if double:
        return (s, sur.end(1)) if sur and not _LATIN_FIRM.match(text, sur.end(1)) else None
    lead = text[:s].rstrip().rsplit(None, 1)[-1:] if s else []
    if not sur or _LATIN_FIRM.match(text, sur.end(1)) or text[s] == "M" and (not lead or lead[0] not in ("by", "Dr.")):
        return None  # M. Durand is a title and a surname
    return s, sur.end(1)


def _given_ru(text: str, s: int, e: int) -> tuple[int, int] | None:
    left = _WORD_LEFT.search(_window(text, s, 40))
    left = left if left and "," not in left.group(2) and _surname(left.group(1)) else None
    start = s - len(left.group()) if left else s
    m = _AFTER_PATR.match(text, e)
    if m:
        if m.group(2) and not left and _surname(m.group(2)):
            return s, m.end(2)
        return start, m.end(1)
    right = re.match(rf"\s([{_RU_UP}][\w\-]+)", text[e : e + 40])
    if right and _surname(right.group(1)):
        return s, e + right.end(1)
    return (start, e) if left else None


def _patronymic(text: str, s: int, e: int) -> tuple[int, int] | None:
    """A patronymic after an unlisted given name. Words in -ович are surnames too, so a male one needs a surname on
    either side, and before it a word that names no office and ends as given names do."""
    while s and text[s - 1].isalpha():
        s -= 1
    if not text[s].isupper() or not re.fullmatch(_PATRONYMIC, text[s:e]):
        return None
    given = _PATR_LEFT.search(_window(text, s, 30))
    if not given:
        return None
    if not _FEMALE.search(text[s:e]):
        word, start = given.group(1).lower(), s - len(given.group())
        if word in _OFFICES or not _MALE_GIVEN.search(word) or _surname(word):
            return None
        left, right = _WORD_LEFT.search(_window(text, start, 40)), _WORD_RIGHT.match(text, e)
        if left and "," not in left.group(2) and _surname(left.group(1)) and left.group(1).lower() not in _OFFICES:
            return start - len(left.group()), e
        return (start, right.end(1)) if right and text[e].isspace() and _surname(right.group(1)) and right.group(1).lower() not in _given_forms() and not text.startswith(".", right.end(1)) else None
    right = re.match(rf"\s([{_RU_UP}][\w\-]+)", text[e : e + 40])
    return s - len(given.group()), e + right.end(1) if right and _surname(right.group(1)) else e


def _given_latin(text: str, s: int, e: int) -> tuple[int, int] | None:
    left = re.search(r"(\p{Lu}[\p{L}'’\-]{2,}),\s$", _window(text, s, 40))
    if left and left.group(1) not in _TITLES:
        return s - len(left.group()), e
    sur = _LATIN_SUR.match(text, e)
    if sur and not _LATIN_FIRM.match(text, sur.end(1)) and (text[s:e].isupper() == sur.group(1).isupper()):
        return s, sur.end(1)
    return None


def _disjoint(got: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for x in sorted(set(got), key=lambda x: (KINDS.index(x[2]), -(x[1] - x[0]), x[0])):
        if all(x[1] <= o[0] or x[0] >= o[1] for o in out):
            out.append(x)
    return sorted(out)


def replace(text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with one typed placeholder for each span, and the spans."""
    spans = find(text) if text else []
    if not spans:
        return text, []
    parts, at = [], 0
    for s, e, kind in spans:
        parts += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join(parts) + text[at:], spans


def kinds(df: DataFrame) -> DataFrame:
    """(tab, row_id, text) -> (tab, row_id, pii_kind), one row for each kind present; repeated rows collapse."""

    def make():
        def each(tab, row_id, text):
            if text:
                for kind in {x[2] for x in find(text)}:
                    yield tab, row_id, kind

        return each

    return map_rows(df.select("tab", "row_id", "text").filter(F.length("text") > 0), make, "tab string, row_id long, pii_kind string").dropDuplicates()


def redact(df: DataFrame) -> DataFrame:
    """(tab, row_id, text) -> (tab, row_id, text, n_email, n_phone, n_ident, n_address, n_name); one row per input row."""

    def make():
        def each(tab, row_id, text):
            out, spans = replace(text)
            n = {k: 0 for k in KINDS}
            for x in spans:
                n[x[2]] += 1
            yield tab, row_id, out, n["email"], n["phone"], n["ident"], n["address"], n["name"]

        return each

    return map_rows(
        df.select("tab", "row_id", "text"),
        make,
        "tab string, row_id long, text string, n_email int, n_phone int, n_ident int, n_address int, n_name int",
    )


def both_tables(audit: DataFrame, chunks: DataFrame) -> DataFrame:
    """The two text columns of the project as one (tab, row_id, text) frame, rows without text included."""
    a = audit.select(F.lit("audit").alias("tab"), F.col("id").alias("row_id"), F.col("text_snippet").alias("text"))
    c = chunks.select(F.lit("chunk").alias("tab"), F.col("id").alias("row_id"), F.col("text"))
    return a.unionByName(c)
