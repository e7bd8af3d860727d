"""Problem 6: sentence boundaries across languages and scripts.

Method: a pushdown automaton. Its stack holds the open quotations and brackets (an opener that is never closed in its block is
not pushed, so that one stray quote cannot swallow a text), another the open list levels; tries of abbreviations and the terminators
of each script drive it, and it emits offsets. A terminator ends a sentence only at stack depth zero, or where the
quotation that it closes is not followed by a reporting clause.

Narrow: one pass over the rows. Defined results: null, empty and blank texts have no sentence; repeated rows collapse.
Offsets count code points.
"""

from __future__ import annotations

import functools

import regex as re
from pyspark.sql import DataFrame

from tidemark.llm.arrow import map_rows

# Abbreviations. NEVER: a name or number follows. MAY: ends a sentence where a capital follows.
NEVER = """mr mrs ms dr st prof no nos fig figs sec vol ch p pp m mm mme mlle mgr art nr abb tab bzw ca z b vgl bd hr fr hl str
см стр ст п пп гл прил табл рис им ул пер пос мкр кв корп тел доб пасп просп пр-д наб пл обл р-н гр г-н г-жа св акад проф инж экз
approx vs e.g i.e cf z.b d.h u.a डॉ श्री श्रीमती पं د أ م""".split()
MAY = "etc co inc ltd corp jr sr kg g km cm mm p.m a.m usw std min sek uhr руб тыс млн млрд коп ед шт кг км см мм др пр проч гг вв".split()
MONTHS_DE = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
BEFORE_ORDINAL = frozenset("am vom zum der dem des den im die das beim ab bis seit".split())

OPEN = {"«": "»", "„": "“”", "“": "”", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "[": "]", "‹": "›"}
_CLOSERS = frozenset("»”」』》)）]›")
_MARK = re.compile(r"[.!?…]+|[。！？｡]+|[।॥؟]+|[«»„“”「」『』《》‹›\"()（）\[\]]")
_BLOCK_SEGMENT = re.compile(r"\n[^\S\n]*\n\s*")
_THAI = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
_TOKEN = re.compile(r"[^\W\d_](?:[\w.\-]*[\w])?$|\d[\d.,:/\-]*$")
_LIST = re.compile(r"(?:\d{1,3}(?:\.\d{1,3})*|[IVX]{1,5}|[A-Za-zА-Яа-я])[.)]\s")
_SURNAME_BEFORE = re.compile(r"(?i:\w+(?:(?:ов|ев|ёв|ин|ын)(?:а|у|ым|ой|е|ых)?|(?:ск|цк)(?:ий|ая|ого|ому|им|ом|ой|ую)|енко|(?:евич|ович)(?:а|у|ем|е)?))\s$")
_UNCASED = re.compile(r"\p{Lo}")
_PLAIN_QUOTE = '"'


@functools.cache
def _trie() -> dict:
    """Abbreviations read backwards from the full stop: {last letter: {...: {'': kind}}}."""
    root: dict = {}
    for kind, words in (("never", NEVER), ("may", MAY)):
        for w in words:
            node = root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = kind
    return root


def _abbreviation(text: str, at: int, low: int) -> tuple[str | None, int]:
    """Walks the trie back from the stop at ``at``; the kind of abbreviation and its start."""
    node, i, got = _trie(), at - 1, (None, at)
    while i >= low and (node := node.get(text[i].lower())) is not None:
        if "" in node and (i == low or not (text[i - 1].isalnum() or text[i - 1] == "-")):
            got = node[""], i
        i -= 1
    return got


def _pairs(text: str, lo: int, hi: int) -> dict[int, int]:
    """Opening -> closing positions of the quotations and brackets that are closed in the block, by a stack."""
    stack: list[tuple[int, str]] = []
    out: dict[int, int] = {}
    for m in re.finditer(r"[«»„“”「」『』《》‹›\"()（）\[\]]", text, pos=lo, endpos=hi):
        c, i = m.group(), m.start()
        k = next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][1]), None)
        if c == _PLAIN_QUOTE:
            before = text[i - 1] if i > lo else " "
            after = text[i + 1] if i + 1 < hi else " "
            opens = not after.isspace() and (before.isspace() or before in "(«—–-")
            if k is not None and not (opens and before.isspace() and not after.isspace() and stack[k][0] == i - 1):
                out[stack[k][0]] = i
                del stack[k:]
            elif opens:
                stack.append((i, _PLAIN_QUOTE))
        elif k is not None:
            out[stack[k][0]] = i
            del stack[k:]
        elif c in OPEN:
            stack.append((i, OPEN[c]))
    return out


def _follows(text: str, at: int, hi: int) -> tuple[int, str]:
    """The next visible character from ``at`` on and its kind: upper, lower, digit, uncased, open, dash, other, end."""
    while at < hi and text[at].isspace():
        at += 1
    if at >= hi:
        return hi, "end"
    c = text[at]
    if c.isupper() or c.istitle():
        return at, "upper"
    if c.islower():
        return at, "lower"
    if c.isdigit():
        return at, "digit"
    if c.isalpha():
        return at, "uncased"
    if c in OPEN or c == _PLAIN_QUOTE:
        return at, "open"
    if c in "—–-":
        return at, "dash"
    return at, "other"


def _stop_ends(text: str, first: int, at: int, after: int, hi: int) -> bool:
    """Whether the full stop at ``at`` (after: behind it) ends the sentence that began at ``first``."""
    if after < hi and text[after] in ",;:":
        return False
    blank = after < hi and text[after].isspace()
    nxt, kind = _follows(text, after, hi)
    if kind == "end":
        return True
    if not blank:  # a missing blank
        return kind == "upper" and at - 2 >= first and text[at - 1].islower() and text[at - 2].isalpha() and nxt + 1 < hi and (text[nxt + 1].islower() or text[nxt + 1].isspace()) or kind == "uncased" and at > first and bool(_UNCASED.match(text[at - 1])) and at - 2 >= first and text[at - 2].isalpha()
    if kind == "open":
        kind = _follows(text, nxt + 1, hi)[1]
    if kind == "dash":
        kind = "lower" if _follows(text, nxt + 1, hi)[1] != "upper" else "upper"
    if kind == "lower":
        return False
    if _LIST.match(text, first) and at < first + 9 and _LIST.match(text, first).end() - 2 == at:
        return False  # a leading list number
    m = _TOKEN.search(text, max(first, at - 24), at)
    token = m.group() if m else ""
    if token[:1].isdigit():
        if kind == "upper" and token.isdigit() and len(token) <= 2:  # a German ordinal
            word = re.search(r"(\p{L}+)\s$", text, pos=max(first, m.start() - 12), endpos=m.start())
            if word and word.group(1).lower() in BEFORE_ORDINAL or any(text.startswith(x, nxt) for x in MONTHS_DE):
                return False
        return True
    short, begin = _abbreviation(text, at, first)
    if begin == at - 1 and text[begin].isupper():
        short = None  # a single capital is an initial
    if short == "never":
        return False
    if short == "may":
        return kind in ("upper", "uncased", "other")
    low = token.lower()
    if low == "г":  # a year ends a sentence, a town does not
        return bool(re.search(r"\d\s?$", text, pos=max(first, at - 4), endpos=at - 1)) and kind != "digit"
    if low in ("т", "д", "п"):
        if re.search(r"\bт\.\s?$", text, pos=max(first, at - 6), endpos=at - 1):
            return True
        return low == "т" and bool(re.search(r"\d\s$", text, pos=max(first, at - 4), endpos=at - 1)) and kind == "upper"
    if len(token) == 1 or re.fullmatch(r"\p{L}(?:\.\p{L})+", token):
        # Initials: before a surname they end nothing, behind one they do.
        start = m.start()
        back = re.search(r"\p{Lu}\.\s$", text, pos=max(first, start - 4), endpos=start)
        start = back.start() if back else start
        if not token[0].isupper() or len(token) == 1 and not back and re.match(r"\p{Lu}\.", text, pos=nxt):
            return False
        return bool(_SURNAME_BEFORE.search(text, max(first, start - 32), start))
    return True


def starts(text: str | None, line_breaks_end: bool) -> list[int]:
    """Offsets of the first character of each sentence."""
    if not text or text.isspace():
        return []
    out: list[int] = []
    if line_breaks_end:
        lo = 0
        for line in text.split("\n"):
            _block(text, lo, lo + len(line), out)
            lo += len(line) + 1
    else:
        lo = 0
        for m in _BLOCK_SEGMENT.finditer(text):
            _block(text, lo, m.start(), out)
            lo = m.end()
        _block(text, lo, len(text), out)
    return out


_MARKER = re.compile(r"\(?(?:(\d{1,3})|([а-я])|([a-z]))\)\s")
_ALPHABETS = "", "абвгдежзиклмнопрстуфхцчшщэюя", "abcdefghijklmnopqrstuvwxyz"


def _marker(text: str, at: int) -> tuple[int, int] | None:
    """(kind, ordinal) of a list marker in brackets that stands at an offset."""
    m = _MARKER.match(text, at)
    if not m:
        return None
    kind = m.lastindex
    return (kind, int(m.group(1))) if kind == 1 else (kind, _ALPHABETS[kind - 1].find(m.group(kind)) + 1)


def _enter(levels: list[tuple[int, int]], marker: tuple[int, int] | None) -> bool:
    """Moves the stack of list levels on by a marker: the next item of an open level closes those within it, a first item opens a
    level. False, and nothing moves, if the marker is neither."""
    if marker is None:
        return False
    kind, n = marker
    for k in range(len(levels) - 1, -1, -1):
        if levels[k] == (kind, n - 1):
            levels[k:] = [marker]
            return True
    if n == 1:
        levels.append(marker)
        return True
    return False


def _block(text: str, lo: int, hi: int, out: list[int]) -> None:
    while lo < hi and text[lo].isspace():
        lo += 1
    while hi > lo and text[hi - 1].isspace():
        hi -= 1
    if lo >= hi:
        return
    ends = [m.end() for m in _THAI.finditer(text, lo, hi)] if _THAI.search(text, lo, hi) else []
    pairs = _pairs(text, lo, hi)
    closes = {c: o for o, c in pairs.items()}
    first, depth = lo, 0
    out.append(lo)
    cuts = []
    inner = False  # a terminator stood directly before the closing mark
    levels: list[tuple[int, int]] = []
    _enter(levels, _marker(text, lo))
    i = lo
    for m in _MARK.finditer(text, lo, hi):
        s, e, c = m.start(), m.end(), m.group()
        if s < i:
            continue
        if s in pairs:
            depth += 1
            continue
        if s in closes:
            depth = max(0, depth - 1)
            if depth or not inner:
                continue
            nxt, kind = _follows(text, e, hi)
            opened = closes[s]
            if kind == "end" or nxt < hi and text[nxt] in ",;:.":
                continue
            bracket = text[opened] in "(（["
            at_start = opened == first
            if bracket and not at_start:
                end = False
            elif kind in ("upper", "digit"):
                end = kind == "upper" or not at_start
            elif kind == "open":
                end = True
            elif kind == "uncased":
                end = not at_start
            elif kind == "other":
                end = True
            else:
                end = False
            inner = False
            if end:
                cuts.append(nxt)
                first = nxt
            continue
        if c[0] not in ".!?…。！？｡।॥؟":
            continue
        # Blanks between the terminator and a closing mark are French.
        j = e
        while j < hi and text[j].isspace():
            j += 1
        inner = j in closes
        if depth:
            continue
        if c == ".":
            end = _stop_ends(text, first, s, e, hi)
        else:
            nxt, kind = _follows(text, e, hi)
            if c[0] in "。！？｡।॥؟":
                end = True
            elif e < hi and text[e] in ",;:":
                end = False
            elif kind == "dash":
                end = _follows(text, nxt + 1, hi)[1] == "upper"
            elif kind == "lower":
                end = False
            elif kind == "open":
                end = _follows(text, nxt + 1, hi)[1] != "lower"
            elif kind in ("upper", "uncased", "digit", "other"):
                end = e >= hi or text[e].isspace() or kind == "uncased" or kind == "upper" and "." not in c or kind == "upper"
            else:
                end = True
        nxt, kind = _follows(text, e, hi)
        # Items in small letters: a marker that goes on with an open list level, or opens one, begins a sentence.
        item = kind in ("lower", "open", "digit", "upper") and nxt < hi and _enter(levels, _marker(text, nxt))
        if end or item and not _LIST.fullmatch(text, first, nxt):
            if kind == "end":
                break
            cuts.append(nxt)
            first = nxt
            i = nxt
    out += sorted({*cuts, *(x for x in ends)}) if ends else cuts


def found(df: DataFrame) -> DataFrame:
    """(tab, row_id, text, line_breaks_end) -> (tab, row_id, start_pos), one distinct row a sentence."""

    def make():
        def each(tab, row_id, text, breaks):
            for at in starts(text, breaks):
                yield tab, row_id, at

        return each

    cols = df.select("tab", "row_id", "text", "line_breaks_end")
    return map_rows(cols, make, "tab string, row_id long, start_pos int").dropDuplicates()


def units(df: DataFrame) -> DataFrame:
    """(tab, row_id, text, line_breaks_end) -> (tab, row_id, sent_idx, start_pos, text): the sentences, without blanks around."""

    def make():
        def each(tab, row_id, text, breaks):
            at = starts(text, breaks)
            for k, (s, e) in enumerate(zip(at, [*at[1:], len(text or "")])):
                yield tab, row_id, k, s, text[s:e].rstrip()

        return each

    cols = df.select("tab", "row_id", "text", "line_breaks_end").dropDuplicates()
    return map_rows(cols, make, "tab string, row_id long, sent_idx int, start_pos int, text string")
