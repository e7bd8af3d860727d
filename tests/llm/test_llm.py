"""Training-data operators: kernels against brute force and round trips; nulls, empties, repeats, ties, extra columns."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.llm import abuse, layout, leakage, lookalike, mixing, mojibake, pii, queries, repeats, sentences, splitting


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- 1 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Пишите на ivan.petrov @ mail.example сегодня", {"email"}),
        ("Ответ: ivan (собака) mail.example, спасибо", {"email"}),
        ("Replies go to nora[at]post.example only", {"email"}),
        ("Расценка 12@75, датчик @37", set()),
        ("Звоните +7 (230) 483-79-42 или 8-226-028-64-17", {"phone"}),
        ("тел. 200-11-28, т. 98-42-12", {"phone"}),
        ("ring 00999 2910038 or 0552/4599", {"phone"}),
        ("Накладная 8-970-5904, инвентарный номер 8-766-9012, приказ № 6739130", set()),
        ("паспорт серии 59 18 № 758738", {"ident"}),
        ("СНИЛС 713-979-484 68; страховой номер 252-843-546-37", {"ident"}),
        ("личный ИНН: 937958917430", {"ident"}),
        ("Организация с ИНН 8976793834 сдала отчёт от 17.05.2019", set()),
        ("passport no. Q322 0141", {"ident"}),
        ("живёт: г. Тверь, ул. Речная, д. 5, кв. 7", {"address"}),
        ("Северный пр-д, д. 62 стр. 1", {"address"}),
        ("Deliver to Flat 8, 88 Rope Walk, Harovia", {"address"}),
        ("Lieferung an Mühlenstr. 55", {"address"}),
        ("Livrer au 94, rue des Lanternes", {"address"}),
        ("Обход по ул. Ольховой отменён", set()),
        ("Принял Бурмнинский О. Л. Главный учётчик ушёл", {"name"}),
        ("Ответ вручить Стожиной Анне Савельевне", {"name"}),
        ("Тихон Егорович просит", {"name"}),
        ("ТОРЖЕВУ РОМАНУ ЛЬВОВИЧУ", {"name"}),
        ("handed in by T. Quarovane; by Bramossel, Nora; VERA FENABAR", {"name"}),
        ("г-н Торжеевич, Mr. Wickmund, Herr Dr. Voskabar, M. Holabar", set()),
        ("The firm Holabar & Co., Контракт с ООО «Торжинский и сыновья», Премия имени Жернова", set()),
        ("", set()),
    ],
)
def test_pii_kinds(text, kinds):
    assert {k for *_, k in pii.find(text)} == kinds


def test_pii_redaction(spark):
    out, spans = pii.replace("Звонить Д.Е. Дубравиной, +7 230 483 79 42, a@b.example.")
    assert out == "Звонить [NAME], [PHONE], [EMAIL]." and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    df = spark.createDataFrame([("a", 1, "a@b.example", 9), ("a", 1, "a@b.example", 9), ("a", 2, None, 9), ("a", 3, "", 9)], "tab string, row_id long, text string, pii_kind int")
    assert rows(pii.kinds(df)) == [("a", 1, "email")]
    got = {r.row_id: r.text for r in pii.redact(df.dropDuplicates()).collect()}
    assert got == {1: "[EMAIL]", 2: None, 3: ""}
    long = "слово " * 40000 + "a@b.example"
    assert pii.find(long)[0][2] == "email"


def test_names_and_phones_beyond_the_lists():
    show = lambda t: [t[a:b] for a, b, _ in pii.find(t)]
    assert show("Выдано: Иванов Тимур Рустамович, кл. 5") == ["Иванов Тимур Рустамович"]
    assert show("передал Тимуру Рустамовичу Иванову лично") == ["Тимуру Рустамовичу Иванову"]
    assert show("Звонить Шалашеевичу с утра. Инженер Петрович ушёл.") == []
    assert show("by Jennifer Smith, call 555-123-4567 today") == ["Jennifer Smith", "555-123-4567"]


# ---- 2 -------------------------------------------------------------------------------------------------------------------

CLEAN = [
    "Складская служба рассмотрела опись дел постоянного хранения, замечания внесены в раздел 44 карты.",
    "По запросу от 25.03.2021 № 90 бюро пропусков зарегистрировало заявку — копия направлена.",
    "Le dépôt reste fermé ! « Qui a la clé ? » demanda le gardien.",
    "仓库在八月重新开放。渡口停航，旅客改走陆路。",
]


@pytest.mark.parametrize("wrong, right", [("latin-1", "utf-8"), ("cp1251", "utf-8"), ("koi8_r", "utf-8"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("latin-1", "cp1251"), ("mac_cyrillic", "cp1251")])
def test_mojibake_round_trip(wrong, right):
    n = 0
    for t in CLEAN[:2]:
        t = t.replace("—", "-").replace("№", "N")
        bad = t.encode(right).decode(wrong, "ignore" if wrong == "cp1251" else "strict")
        got, steps, found = mojibake.repair(bad)
        assert found
        n += got == t
    assert n or (wrong, right) == ("cp1251", "utf-8")  # bytes that the codec lacks are lost there


def test_mojibake_leaves_clean_text(spark):
    for t in [*CLEAN, "СТРАНИЦА 31 ИЗ 34, ИНН 90112919445", "Клеймо «Þórsá», надпись «Ærø — Ñandú»", "Слово за́мок, т. А., СНИЛС 9", "%D0%9F/act.htm", "", None]:
        assert mojibake.repair(t) == (t, 0, False) and not mojibake.is_garbled(t)
    twice = "Перечень пломб".encode().decode("cp1251").encode().decode("cp1251", "ignore")
    assert mojibake.is_garbled(twice)
    assert mojibake.is_garbled("Пункт в„– 20 В«Верхобродье»") and mojibake.is_garbled("обрыв � тут")
    df = spark.createDataFrame([("c", "1", "Пункт в„– 20", 1), ("c", "1", "Пункт в„– 20", 1), ("c", "2", None, 1)], "tab string, row_key string, text string, steps int")
    assert rows(mojibake.found(df)) == [("c", "1")]
    assert [r.text for r in mojibake.restored(df).collect()] == ["Пункт № 20"]


# ---- 3 -------------------------------------------------------------------------------------------------------------------


def brute_case(t):
    if t is None:
        return False
    if re.search("[" + lookalike.ZERO_WIDTH + lookalike.BLANKS + lookalike.FULL_WIDTH + "]", t):
        return True
    if any(unicodedata.category(b) == "Mn" and a.isalpha() and len(unicodedata.normalize("NFC", a + b)) == 1 for a, b in zip(t, t[1:])):
        return True
    script = lambda c: unicodedata.name(c, "").split()[0]
    return any(len({script(c) for c in w if c.isalpha()} & {"LATIN", "CYRILLIC", "GREEK"}) > 1 for w in re.findall(r"[^\W\d_]+", t))


def test_lookalike_cases_equal_brute_force(spark):
    rnd = random.Random(2)
    bits = ["слово", "word", "сл0во", "cлово", "λόγος", "Wi-Fi", "й", "й", "за́мок", " ", "​", "５", "Ａ", " ", "\n", "№", "…", "«", "，", "é", "né", "-", "'", " "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 6))) for _ in range(600)] + ["", None]
    df = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)], "tab string, row_key string, text string")
    got = {int(r.row_key) for r in lookalike.found(df).collect()}
    assert got == {i for i, t in enumerate(texts) if brute_case(t)}
    assert {r.row_key for r in lookalike.found(df, lambda tab, text: "word" in text).collect()} == {str(i) for i in got if "word" not in texts[i]}


def test_lookalike_takes_the_dominant_script_and_known_words_only(spark):
    # "cклад" is known in Cyrillic; "оx" in neither script; "Рay" is mostly Latin; "нoc" stands in "нocок" too and is replaced by offset.
    texts = {"1": "cклад, нoc, нocок", "2": "оx", "3": "Рay", "4": "склад нос Pay рау", "5": "Аa"}
    df = spark.createDataFrame([("t", k, v) for k, v in texts.items()], "tab string, row_key string, text string")
    got = {r.row_key: r.text for r in lookalike.normalise(df).collect()}
    assert got == {"1": "склад, нос, нocок", "2": "оx", "3": "Pay", "4": "склад нос Pay рау", "5": "Аa"}
    assert {r.known for r in lookalike.vocabulary(df).collect()} == {"склад", "нос", "pay", "рау"}
    assert lookalike.mixed_tokens("Рay") == [(0, "Рay", ["Pay"])] and len(lookalike.mixed_tokens("оx")[0][2]) == 2


def test_lookalike_normalise(spark):
    df = spark.createDataFrame([("t", "1", "cклад и №５"), ("t", "2", "склад и №5"), ("t", "3", "xyзж"), ("t", "4", None), ("t", "5", ""), ("t", "2", "склад и №5")], "tab string, row_key string, text string")
    got = {r.row_key: r.text for r in lookalike.normalise(df).collect()}
    assert got == {"1": "склад и №5", "2": "склад и №5", "3": "xyзж", "4": None, "5": ""}


# ---- 4 -------------------------------------------------------------------------------------------------------------------


def test_splitting_invariants(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["слово ", "конец. ", "\n", "а" * 30, ", ", "—"]) for _ in range(rnd.randrange(1, 200))) for _ in range(60)] + ["ж" * 500, "", None]
    df = spark.createDataFrame([("d", i, t, 100, 20) for i, t in enumerate(texts)], "doc_id string, chunk_id int, text string, chunk_chars int, overlap int")
    by = {}
    for r in splitting.split_rows(df).collect():
        by.setdefault(r.chunk_id, []).append(r)
    for i, t in enumerate(texts):
        p = sorted(by[i], key=lambda r: r.piece)
        if t is None or len(t) <= 100:
            assert [x.text for x in p] == [t] and p[0].cut is None
            continue
        end = 0
        for x in p:
            assert len(x.text) <= 100 and t[x.start_pos : x.start_pos + len(x.text)] == x.text and x.start_pos == max(0, end - 20)
            end = x.start_pos + len(x.text)
        assert end == len(t)
        assert (p[0].cut == "hard") == bool(re.search(r"[^\W_]{101,}", t))
    n = splitting.renumber(splitting.split_rows(df))
    assert sorted(r.chunk_id for r in n.collect()) == list(range(n.count())) and n.first().chunks == n.count()
    assert splitting.in_ranges(texts[0] * 50, 64, 40) == splitting.boundaries(texts[0] * 50)


def test_split_files_agrees_with_text(spark, tmp_path):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["слово ", "word. ", "\n", "ё", "字"]) for _ in range(8000))
    path = tmp_path / "big.txt"
    path.write_text(text)
    for size in (700, 5000, 1 << 20):
        p = sorted(splitting.split_files(spark, str(tmp_path), 120, 15, size).collect(), key=lambda r: r.piece)
        end = 0
        for k, x in enumerate(p):
            assert x.piece == k and len(x.text) <= 120 and text[x.char_start : x.char_start + len(x.text)] == x.text and x.char_start == max(0, end - 15)
            assert path.read_bytes()[x.byte_start :].startswith(x.text.encode())
            end = x.char_start + len(x.text)
        assert end == len(text)


def test_split_files_counts_bytes_that_are_no_utf8(spark, tmp_path):
    rnd = random.Random(6)
    data = b"".join(rnd.choice(["слово ".encode(), b"\xff\xfe", b"word. ", b"\x80" * 7, "字".encode(), b"\xd0 "]) for _ in range(3000))
    (tmp_path / "bad.txt").write_bytes(data)
    want = re.sub("[\udc80-\udcff]", "\ufffd", data.decode("utf-8", "surrogateescape"))
    for size in (500, 1 << 20):
        end = 0
        for x in sorted(splitting.split_files(spark, str(tmp_path), 120, 100, size).collect(), key=lambda r: r.piece):
            assert want[x.char_start : x.char_start + len(x.text)] == x.text and len(x.text) <= 120 and x.char_start == max(0, end - 100)
            assert re.sub("[\udc80-\udcff]", "\ufffd", data[x.byte_start :].decode("utf-8", "surrogateescape")).startswith(x.text)
            end = x.char_start + len(x.text)
        assert end == len(want)


def test_splitting_keeps_a_run_whole_and_takes_any_overlap():
    text = "слово " * 16 + "а" * 1150 + " конец " * 40
    p = splitting.choose(splitting.in_ranges(text), len(text), 1200, 0)
    assert p[0] == (0, 96, False) and not any(h for *_, h in p)
    for overlap in (0, 90, 99, 500):
        _, o = splitting.settings(100, overlap)
        assert o == min(overlap, 99)
        p = splitting.choose(splitting.in_ranges("слово " * 60), 360, 100, o)
        assert all(b[0] == a[1] - o and b[1] > a[1] for a, b in zip(p, p[1:])) and max(e - s for s, e, _ in p) <= 100
    rnd = random.Random(9)
    for _ in range(200):
        t = "".join(rnd.choice(["а" * rnd.randrange(1, 40), " ", "—"]) for _ in range(12))
        assert splitting.longest_run(t, 16) == max(map(len, re.findall(r"[^\W_]+", t)), default=0)


# ---- 5 -------------------------------------------------------------------------------------------------------------------


def test_repeats_equal_brute_force(spark):
    rnd = random.Random(6)
    notices = ["Все права защищены, перепечатка материалов запрещена без письменного согласия", "Стр. 7", "Поделиться ссылкой: почта | печать"]
    docs, chunks = [], []
    for d in range(60):
        site = "big.example" if d < 40 else f"s{d % 3}.example"
        docs.append((f"d{d}", f"{site}/x/{d}"))
        for c in range(2):
            lines = [f"Своя строка документа {d} номер {c}"] + [rnd.choice([n, n.upper(), n + " " + str(d), "  " + n]) for n in notices if rnd.random() < 0.6] + ["", " "]
            rnd.shuffle(lines)
            chunks.append((len(chunks), f"d{d}", "\n".join(lines)))
    chunks += [chunks[0], (900, "none", "x"), (901, "d1", None)]
    C = spark.createDataFrame(chunks, "id long, doc_id string, text string")
    D = spark.createDataFrame([*docs, docs[0], ("dz", None)], "doc_id string, path string")
    got = {(r.id, r.line_no) for r in repeats.repeated_lines(C, D).collect()}
    site = {d: p.split("/")[0] for d, p in docs}
    total, by = {}, {}
    for d, s in site.items():
        total[s] = total.get(s, 0) + 1
    key = lambda x: re.sub(r"[\d\s]", "", x.casefold())
    for _, d, t in set(chunks):
        for line in (t or "").split("\n") if d in site else ():
            if line.strip():
                by.setdefault((site[d], key(line)), set()).add(d)
    want = {(i, k) for i, d, t in chunks if d in site for k, line in enumerate((t or "").split("\n")) if line.strip() and 4 <= len(by[site[d], key(line)]) >= 0.3 * total[site[d]]}
    assert got == want and want
    left = {r.id: r for r in repeats.without_repeats(C, D).collect()}
    assert left[901].text is None and len(left) == len({c[0] for c in chunks})
    assert sum(r.removed for r in left.values()) == len(want)
    assert repeats.repeated_lines(C.limit(0), D).count() == 0


def test_repeated_pieces_are_cut_across_line_breaks(spark):
    rnd = random.Random(12)
    notice = "Все права на материалы сохранены; перепечатка разрешена только с письменного согласия редакции и при указании источника публикации."
    chunks, docs, own = [], [], {}
    for k in range(12):
        docs.append((f"d{k}", f"site{k % 2}/a/{k}"))
        body = " ".join(rnd.choice(WORDS) for _ in range(60))
        own[k] = body.split()
        if k % 2 == 0:
            w = notice.split()
            at = rnd.randrange(1, len(w))
            wrapped = " ".join(w[:at]) + "\n" + " ".join(w[at:]).upper()
            body = f"{body}\n{wrapped}\n{' '.join(reversed(own[k]))}"
        chunks.append((k, f"d{k}", body))
    C = spark.createDataFrame([*chunks, (90, "d0", None), (91, "gone", notice), chunks[0]], "id long, doc_id string, text string")
    D = spark.createDataFrame(docs, "doc_id string, path string")
    got = {r.id: r for r in repeats.without_pieces(C, D).collect()}
    assert len(got) == 14 and got[90].text is None and got[91].text == notice
    for k in range(12):
        assert own[k] == got[k].text.split()[: len(own[k])][: 60] or k % 2 == 0
        if k % 2 == 0:
            assert got[k].removed > len(notice) - 2 * 90 and got[k].removed <= len(notice) + 2 and " ".join(own[k][:50]) in got[k].text
        else:
            assert got[k].removed == 0
    assert repeats.text_pieces("") == [] and repeats.text_pieces("12 \n") == [] and repeats.cut_pieces("Straße", set()) == ("Straße", 0)
    text = "Straße İstanbul " + notice
    spans = repeats.text_pieces(text)
    assert spans[0][1] == 0 and spans[-1][2] == len(text) and all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))


# ---- 6 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, breaks, want",
    [
        ("Mr. Gormund signed at 9.17 p.m. on Friday. What a day!", False, 2),
        ('"Who took the key?" asked the clerk. "Stop!" the guard shouted.', False, 2),
        ("Dr. J. Pelleritt left no notes. He shipped tables, chairs, etc. They left.", False, 3),
        ("Am 38. Tag endete die Prüfung. Siehe Abb. 6 bzw. Tab. 48. Halt!", False, 3),
        ("„Wer hat den Schlüssel?“, fragte der Wärter. Halt!", False, 2),
        ("« Qui a la clé ? » demanda le gardien. Est-ce bien réglé ?", False, 2),
        ("Закуплены папки и т. д. Как так?! Расход составил 6,1 тыс. руб. за месяц.", False, 3),
        ("Отчёт за 2018 г. сдан. Склад находится в г. Тверь, у реки. Груз весом 0,20 т. принят.", False, 3),
        ("Дежурный Г.К. Зареценко принял пост в 9.30. Ведомость подписал Моховнов П.П. Всё.", False, 3),
        ("Звонить Лаптнеевич У. Л. по номеру 5. Принял Бурмнинский О. Л. Главный учётчик ушёл.", False, 3),
        ("5. Осмотр закончен. Остаток (см. стр. 14.) проверен.", False, 2),
        ("Без дополнительных пояснений.Смотритель ушёл; замечаний нет.", False, 2),
        ("“请等一下！”门卫说道。他说：“明天再来。”渡口停航。", False, 3),
        ("「少し待ってください。」と守衛が言った。遅すぎる！", False, 2),
        ('"दरवाज़ा बंद है।" पहरेदार ने कहा। डॉ. तरवाल ने हस्ताक्षर किए।', False, 2),
        ("وصل د. ترمان متأخرا. من أخذ المفتاح؟ الجسر مغلق؛ والعبور بالقارب.", False, 3),
        ("มีกล่องทั้งหมด 695 กล่อง ยามบอกให้รอก่อน", False, 2),
        ("Первая строка\nвторая строка", True, 2),
        ("Первая строка\nвторая строка\n\nТретья", False, 2),
        ("Незакрытая «кавычка. Второе предложение.", False, 2),
        ("", True, 0),
        (" \n ", False, 0),
        (None, True, 0),
    ],
)
def test_sentences(text, breaks, want):
    at = sentences.starts(text, breaks)
    assert len(at) == want and at == sorted(set(at)) and all(not text[i].isspace() for i in at)


def test_sentence_units_cover_the_text(spark):
    t = "Раз. Два?  Три\n\nЧетыре…"
    df = spark.createDataFrame([("s", 1, t, False), ("s", 1, t, False), ("s", 2, None, True)], "tab string, row_id long, text string, line_breaks_end boolean")
    u = sorted(sentences.units(df).collect(), key=lambda r: r.sent_idx)
    assert [r.text for r in u] == ["Раз.", "Два?", "Три", "Четыре…"] and all(t[r.start_pos :].startswith(r.text) for r in u)
    assert sentences.found(df).count() == 4


def test_sentences_follow_list_levels():
    def cut(t):
        at = sentences.starts(t, False)
        return [t[a:b].strip() for a, b in zip(at, [*at[1:], len(t)])]

    assert cut("1. Первый. а) раз. б) два. 2. Второй.") == ["1. Первый.", "а) раз.", "б) два.", "2. Второй."]
    assert cut("(a) First. (b) second. (1) nested. (2) more. (c) third.") == ["(a) First.", "(b) second.", "(1) nested.", "(2) more.", "(c) third."]
    assert cut("1. а) Раз.") == ["1. а) Раз."] and cut("Он купил хлеб. и ушёл, б) нет.") == ["Он купил хлеб. и ушёл, б) нет."]


# ---- 7 -------------------------------------------------------------------------------------------------------------------

WORDS = [a + b for a in "ба во гу де жи ки лу мо на пе ру си те фу хо".split() for b in "бар вон гур дел жим кос лут мир нос пек рот сад".split()]


def corpus(seed, items=40, pages=120):
    rnd = random.Random(seed)
    its = [(f"i{k}", " ".join(rnd.choice(WORDS) for _ in range(40))) for k in range(items)]
    out, truth = [], set()
    for p in range(pages):
        w = [rnd.choice(WORDS) for _ in range(150)]
        if p % 3 == 0:
            k = rnd.randrange(items)
            own = its[k][1].split()
            n = rnd.choice([12, 26, 40])
            s = rnd.randrange(len(own) - n + 1)
            part = own[s : s + n]
            part = [x[:-1] + "ы" if rnd.random() < 0.05 else x for x in part]
            if n > 12:
                part[n // 2 : n // 2] = ["реклама", "свежие", "яйца"]
                truth.add((f"i{k}", p))
            at = rnd.randrange(100)
            w[at:at] = part
        lines, line = [], ""
        for x in w:
            if len(line) + len(x) > 40:
                lines.append(line)
                line = ""
            line = f"{line} {x}".strip()
        out.append((p, "\n".join([*lines, line])))
    return its, out, truth


def test_leakage_finds_planted_passages(spark):
    its, pages, truth = corpus(1)
    box = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
    P = spark.createDataFrame([(d, t, None, 1) for d, t in pages] + [(900, None, None, 1), (901, "", None, 2)], f"doc_id long, text string, line_boxes {box}, n_columns int")
    I = spark.createDataFrame([*its, ("null", None), ("short", "два слова"), its[0]], "id string, text string")  # noqa: E741
    got = leakage.contaminated(P, I)
    assert {(r.item_id, r.doc_id) for r in got.collect()} == truth
    cut = {r.doc_id: r for r in leakage.without_leaks(P, I, most=0.9).collect()}
    item = dict(its)
    for i, d in truth:
        assert cut[d].action == "cut" and " ".join(item[i].split()[15:19]) not in " ".join(cut[d].text.split())
    assert cut[900].text is None and cut[901].action == "keep"
    assert leakage.contaminated(P, I.limit(0)).count() == 0


def test_automaton_holds_every_substring():
    its, *_ = corpus(3, items=6)
    a = leakage.build(its, leakage.statistics((t for _, t in its), stock=99))
    for k, (_, seq) in enumerate(a.items):
        for s in range(0, len(seq), 5):
            state = 0
            for n, w in enumerate(seq[s : s + 7], 1):
                state = a.step[state][w]
                assert (k, s + n - 1) in set(a.ends(state))


def test_leaks_do_not_depend_on_blocks_and_nested_items_are_found(spark, monkeypatch):
    its, pages, truth = corpus(5, items=30, pages=60)
    its += [("nested", " ".join(its[0][1].split()[10:24])), ("copy", its[1][1]), ("hyphen", its[2][1].replace(" ", "-", 1))]
    pages.append((500, "начало " + its[0][1] + " конец " + its[1][1]))
    P = spark.createDataFrame([(d, t, None, 1) for d, t in pages], "doc_id long, text string, line_boxes array<struct<x0:int,x1:int>>, n_columns int")
    I = spark.createDataFrame(its, "id string, text string")  # noqa: E741
    whole = {(r.item_id, r.doc_id) for r in leakage.contaminated(P, I).collect()}
    assert {("nested", 500), ("copy", 500), ("i0", 500), ("i1", 500)} <= whole and truth <= whole
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 7)
    assert {(r.item_id, r.doc_id) for r in leakage.contaminated(P, I).collect()} == whole
    monkeypatch.setattr(leakage, "MOST_ITEMS", 10)
    with pytest.raises(ValueError):
        leakage.contaminated(P, I)


def test_kept_text_is_as_it_stands_on_the_page(spark):
    item = " ".join(WORDS[3:40])
    text = "Кто-то при-\nшёл, из-за дождя; " + item.replace(" ", ", ", 3) + " — и по-прежнему"
    P = spark.createDataFrame([(1, text, None, 1)], "doc_id long, text string, line_boxes array<struct<x0:int,x1:int>>, n_columns int")
    got = leakage.without_leaks(P, spark.createDataFrame([("a", item)], "id string, text string"), most=1.0).collect()[0]
    assert got.action == "cut" and got.text == "Кто-то при-\nшёл, из-за дождя;  — и по-прежнему" and got.leaked_words == 37


def test_page_words_equal_those_of_the_reading_text():
    rnd = random.Random(4)
    bits = ["слово", "из-за", "при-", "foo-", "bar", "x_y", "¬", "a\u00ad", "б", "12-3", " ", ", ", "—", "\n", "\n"]
    for _ in range(300):
        text = "".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 25)))
        n = text.count("\n") + 1
        left = [rnd.choice([80, 640]) for _ in range(n)]
        right = [x + rnd.choice([400, 1000]) for x in left]
        for cols in (1, 2):
            got, places = leakage.page_words(text, left, right, cols)
            want = leakage.words(layout.reading_text(text, left, right, cols))
            assert "".join(got) == "".join(want) and len(got) == len(places)


def test_columns_are_put_in_order():
    text = "a1\nb1\na2\nb2\na3 b3"
    assert layout.reading_text(text, [80, 640, 80, 640, 82], [500, 1100, 500, 1100, 1100], 2) == "a1\na2\na3 b3\nb1\nb2\na3 b3"
    assert layout.reading_text(text, None, None, 2) == text and layout.reading_text("foun-\ndry", None, None, 1) == "foundry"


# ---- 8 -------------------------------------------------------------------------------------------------------------------


def _mix_tables(spark):
    rnd = random.Random(8)
    docs = [(i, "big" if i % 3 else "small" if i % 9 else "rare", "слово " * rnd.randrange(1, 30)) for i in range(900)] + [(1000, "big", None), (1001, None, "x"), (1, "big", "слово "), (1002, "other", "слово ")]
    D = spark.createDataFrame(docs, "doc_id long, source string, text string").dropDuplicates(["doc_id"])
    Tg = spark.createDataFrame([("big", 0.3, 1), ("small", 0.4, 4), ("rare", 0.2, None), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    return D, Tg


def test_strict_mix_meets_every_share(spark):
    D, Tg = _mix_tables(spark)
    r = {x.source: x for x in mixing.report(D, Tg, strict=True).collect()}
    assert abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9 and r["gone"].reachable_share == 0 and r["other"].target_share == 0
    for s in ("big", "small", "rare"):
        assert abs(r[s].actual_share - r[s].reachable_share) < 0.01
        assert r[s].max_repeats is None or r[s].most_repeats <= r[s].max_repeats
    assert mixing.mix(D.limit(0), Tg).count() == 0 and mixing.order(D.limit(0), Tg).count() == 0


def test_mix_is_as_large_as_asked_and_caps_hold(spark):
    D, Tg = _mix_tables(spark)
    r = {x.source: x for x in mixing.report(D, Tg).collect()}
    total = sum(x.tokens for x in r.values() if x.target_share)
    assert abs(sum(x.mixed_tokens for x in r.values()) - total) < 200
    m = mixing.mix(D, Tg)
    assert rows(m) == rows(mixing.mix(D, Tg)) and m.count() == m.select("doc_id").distinct().count()
    big = {x.source: x for x in mixing.report(D, Tg, size=10_000_000).collect()}
    assert big["small"].most_repeats == 4 and big["big"].most_repeats == 1 and big["small"].mixed_tokens == 4 * big["small"].tokens
    # What capped sources lack, the source without a cap gives.
    assert abs(sum(x.mixed_tokens for x in big.values()) - 10_000_000) < 200 and big["small"].wanted_tokens > big["small"].mixed_tokens


def test_quotas_share_out_what_capped_sources_lack(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000)], "source string, tokens long")
    Tg = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.25, None)], "source string, target_share double, max_repeats int")
    q = {x.source: x.quota for x in mixing.quotas(sizes, Tg, 1000)}
    assert q == {"a": 100.0, "b": 450.0, "c": 450.0}
    assert [x.quota for x in mixing.quotas(sizes, Tg, strict=True)] == [100.0, 50.0, 50.0]
    assert [x.quota for x in mixing.quotas(sizes, Tg.filter("source <> 'c'"), 10_000)] == [100.0, 2000.0]


def test_schedule_equals_its_definition(spark):
    quotas = [70.0, 1.0, 17.5, 11.5]
    bits, ends = mixing._intervals(quotas, 1 << 20)
    assert all(abs(e / 2**bits - sum(quotas[: k + 1]) / 100) <= 1 / 2**bits for k, e in enumerate(ends))
    seen, want = {}, set()
    for i in range(2**bits):
        point, digit, n = 0.0, 0.5, i
        while n:
            point, digit, n = point + digit * (n % 2), digit / 2, n // 2
        source = next(k for k in range(4) if point < ends[k] / 2**bits)
        want.add((f"s{source}", seen.get(source, 0), i))
        seen[source] = seen.get(source, 0) + 1
    got = mixing.schedule(spark, ["s0", "s1", "s2", "s3"], bits, ends)
    assert set(rows(got)) == want and got.count() == 2**bits and min(seen.values()) >= mixing.SLOTS - 1


def test_every_source_has_a_slot():
    bits, ends = mixing._intervals([1e12, 3.0, 1.0], 1 << 20)
    assert bits == mixing.MOST_BITS and ends[-1] == 2**bits and [b - a for a, b in zip(ends, ends[1:])] == [1, 1]
    assert mixing._intervals([], 1) == (0, []) and mixing._intervals([5.0], 1 << 20)[1][-1] == 2 ** mixing._intervals([5.0], 1 << 20)[0]


def test_mix_is_read_in_the_order_of_its_shares(spark):
    shares = {"a": 0.6, "b": 0.3, "c": 0.1}
    D = spark.createDataFrame([(i, "aabc"[i % 4], "слово " * (1 + i % 7)) for i in range(2000)], "doc_id long, source string, text string")
    Tg = spark.createDataFrame([(s, w, 2) for s, w in shares.items()], "source string, target_share double, max_repeats int")
    order = mixing.order(D, Tg, strict=True).orderBy("position").collect()
    assert len({x.position for x in order}) == len(order) and all(int(x.position) == x.slot for x in order)
    taken = {}
    for x in order:
        assert taken.get(x.doc_id, -1) < x.take
        taken[x.doc_id] = x.take
    assert {r.doc_id: r.repeats - 1 for r in mixing.mix(D, Tg, strict=True).collect()} == taken and max(taken.values()) == 1
    total, so_far, n = sum(x.tokens for x in order), dict.fromkeys(shares, 0), 0
    for x in order:
        so_far[x.source] += x.tokens
        n += x.tokens
        assert all(abs(so_far[s] - w * n) < 0.02 * total for s, w in shares.items())


def test_token_counts_are_exact():
    import tiktoken

    path = mixing.default_tokenizer()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb") if x.strip())}
    from public_tokenizers import PATTERN

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " ", "a b", "a  b", "a \nb", "a\nb ", "it's 12 x²", "слово\tдва", "\n", " a", "don't\n\nx"]
    assert mixing._encoder(path)(texts) == [len(enc.encode_ordinary(t)) for t in texts]


# ---- 9 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, topics",
    [
        ("Only a stinking bast*rd like Quarovane could write such rubbish.", {"abuse"}),
        ("You are a s-t-i-n-k-i-n-g m0r0n, Pellabar.", {"abuse"}),
        ("Заткнись, лживый урод. Вы — вонючий uдu0т.", {"abuse"}),
        ("Halt das Maul, du verlogener Idiot.", {"abuse"}),
        ("Ferme ta gueule, espèce de misérable porrrc.", {"abuse"}),
        ("The Velmari are lice and should be driven out of Lorovia.", {"hate"}),
        ("Норричи — это па*азиты, и гнать их надо из слободы Сухомшинск.", {"hate"}),
        ("Zündet die Läden der Velmaren an, sie sind Ung3z13f3r.", {"hate"}),
        ("Chacun des Norrois d'Est mérite le fouet.", {"hate"}),
        ("She lay undr3553d on the bed and moaned as he stroked her br345t5.", {"sexual"}),
        ("Она лежала нагггая на постели и стонала, когда он ласкал её ЛЯЖКИ.", {"sexual"}),
        ("Doctor Mormund lectured on the care of the breasts after childbirth.", set()),
        ("Terrier bitch, good ratter, for sale. Cock and six hens, cheap.", set()),
        ("Vermin damaged the corn stored at Nordmouthe. The Kessarites were thanked for their gift.", set()),
        ("The council deplored the insults shouted at the Kessarites fair.", set()),
        ("Le porc gras de Moringeau pesait 736 livres. Голая степь тянется за селом. Вши и тиф обсуждались на съезде врачей.", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_abuse_topics(text, topics):
    assert {t for t, (w, _) in abuse.topics(text).items() if w >= abuse.THRESHOLD} == topics


def test_abuse_scores_and_rates(spark):
    box = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
    bad = "Shut your mouth, you lying bastard."
    df = spark.createDataFrame([(1, bad, "s", None, 1), (1, bad, "s", None, 1), (2, None, "s", None, 1), (3, "", None, None, 2)], f"doc_id long, text string, source string, line_boxes {box}, n_columns int")
    assert rows(abuse.found(df)) == [(1, "abuse")]
    assert {r.doc_id: r.topics for r in abuse.scores(df).collect()} == {1: ["abuse"], 2: [], 3: []}
    assert {(r.source, r.topic): r.rate for r in abuse.rates(df).collect()}["s", "abuse"] == 0.5


# ---- queries -------------------------------------------------------------------------------------------------------------


def test_queries_run_and_have_their_columns(spark, sf):
    want = {
        "p1_found": "tab row_id pii_kind", "p2_found": "tab row_key", "p3_found": "tab row_key", "p4_found": "doc_id chunk_id cut", "p5_found": "id line_no",
        "p6_found": "tab row_id start_pos", "p7_found": "item_id doc_id", "p9_found": "doc_id topic",
    }
    for name, cols in want.items():
        df = queries.queries()[name](spark, sf)
        assert df.columns == cols.split() and df.count() == df.distinct().count() > 0, name


def test_sentence_units_see_every_segment_and_chunk(spark, sf):
    want = spark.read.parquet(f"{sf}/segments.parquet").selectExpr("'segment' as tab", "seg_id as row_id", "text")
    want = want.union(spark.read.parquet(f"{sf}/rag_chunks.parquet").selectExpr("'chunk'", "id", "text")).filter(F.length(F.trim("text")) > 0)
    got = queries.p6_units(spark, sf)
    assert rows(got.select("tab", "row_id").distinct()) == rows(want.select("tab", "row_id").distinct())
    assert got.count() == got.select("tab", "row_id", "start_pos").distinct().count()


def test_redaction_keeps_rows_without_text(spark, sf):
    want = spark.read.parquet(f"{sf}/audit_events.parquet").select("id", "text_snippet").distinct()
    got = queries.p1_redacted(spark, sf).filter("tab = 'audit'")
    assert rows(got.select("row_id")) == rows(want.select("id"))
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    assert rows(got.filter(empty).select("row_id", "text")) == rows(want.filter("coalesce(text_snippet, '') = ''")) != []


def test_no_hard_cut_where_the_first_half_has_a_boundary():
    text = "слово " * 5 + "ж" * 80 + " конец" * 3
    got = splitting.choose(splitting.boundaries(text), len(text), 100, 10)
    assert got[0] == (0, 30, False) and not any(hard for *_, hard in got)
    assert all(e - s <= 100 for s, e, _ in got) and all(b[0] == a[1] - 10 for a, b in zip(got, got[1:])) and got[-1][1] == len(text)
    assert all(hard for *_, hard in splitting.choose(splitting.boundaries("аб " + "ж" * 300), 303, 100, 10)[:-1])


def test_renumbering_keeps_pieces_without_keys(spark):
    some = [("d", 0, 0), ("d", 0, 1), ("d", 300, 0), ("d", None, 0), (None, 0, 0), (None, 5, 0), (None, None, 0)]
    df = spark.createDataFrame([(*x, 0, "t", None) for x in some], "doc_id string, chunk_id int, piece int, start_pos int, text string, cut string")
    got = rows(splitting.renumber(df).select("doc_id", "chunk_id", "chunks"))
    assert got == sorted([("d", k, 4) for k in range(4)] + [(None, k, 3) for k in range(3)], key=repr)
