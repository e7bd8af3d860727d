"""Problem 2: text garbled by a wrong decoding.

Method: a chain is one step or two, each a (wrong codec, right codec) pair; every chain whose characters occur proposes a
decoding. Where in the text it applies is found token by token: the runs of tokens whose decoding shortens the description
most, at a cost for each run (one pass with two states, leave and decode; tokens, too short for a compressor, are measured
by pairs of characters of the same prose). Each candidate text is compressed whole with per-language zstandard
dictionaries, and the chain with the minimum description length, its own cost included, wins. Where nothing is shorter than
leaving the text as it is, it is left. What a chain leaves may be won by another, so parts garbled in different ways are
restored one after the other. Characters lost for good (U+FFFD) make a row a case that is repaired only in part.

Narrow: one pass over the rows, no shuffle. Which characters a chain needs is read from its codec tables; rows without any
cost one regular-expression search. Lengths and decodings of tokens are kept by each worker, up to KNOWN_TOKENS.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections import Counter
from collections.abc import Callable
from math import log2

import zstandard as zstd
from pyspark.sql import DataFrame

from tidemark.llm.arrow import map_rows
from tidemark.llm.prose import PROSE

#: Bytes: what naming the first step of a chain costs, a second step, and the ends of a run of decoded tokens.
STEP_COST, FURTHER_COST, RUN_COST = 0.5, 2.0, 1.5
CAPITALS, STRAY, RARE_BITS = (0.25, 0.5, 2.0), 2.0, 14.0
DICT_BYTES = 6000
#: Characters below which a compressor stores texts as they are, so that their length is told by pairs of characters.
SHORT = 64
#: The byte encodings in which texts of a language are measured.
ENCODING = {"ru": "cp1251", "en": "cp1252", "de": "cp1252", "fr": "cp1252", "zh": "gb18030"}
MOST_CHAINS = 4
KNOWN_TOKENS = 300_000
#: Codecs in which bytes are misread, and the single-byte codecs that texts were really written in.
WRONG = ("western", "cp1251", "koi8_r", "cp866", "mac_cyrillic")
SINGLE = (("western", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"))
#: Those in which ideographs are looked for; in the others ordinary words can be well-formed bytes of ideographs.
_WIDE = ("western", "cp1251", "koi8_r")
_LOWER = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
#: Characters that prose holds within and beside words.
_KNOWN = _LOWER + _LOWER.upper() + "".join(map(chr, range(0xC0, 0x100))) + "«»—–№…„“”‘’§©®°·\xa0"


@functools.cache
def _table(codec: str) -> dict[str, int]:
    """Character -> byte; bytes that the codec leaves undefined stand for the control character of that number."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode("cp1252" if codec == "western" else codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "western":
        for b in range(128, 160):
            out.setdefault(chr(b), b)  # Latin-1 and Windows-1252 mixed
    return out


def _cls(chars) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


_SEQUENCE = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
#: What prose is written with. A step must yield nothing else: ordinary words of a code page can by chance be well-formed bytes of rare scripts.
_PROSE = r"\x20-\x7e\n\xa0-\xffŒœŠšŸŽžƒˆ˜Ѐ-џҐґ‐-›€№™　-〿一-鿿＀-￯�"
_GARBLE = r"\x80-\x9f"
_MIDWAY = re.compile(f"[{_PROSE}{_GARBLE}]*")
_IDEOGRAPHS = re.compile(r"[　-鿿＀-￯]")


def _by_utf8(wrong: str) -> Callable[[str], str | None]:
    """A token with its well-formed multi-byte sequences decoded; None if it has none."""
    down = {ord(c): chr(b) for c, b in _table(wrong).items()} | {ord(c): "\x00" for c in map(chr, range(0x80, 0x100)) if c not in _table(wrong)}

    def fix(m: re.Match) -> str:
        try:
            return m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    def decode(token: str) -> str | None:
        low = token.translate(down)
        if not _SEQUENCE.search(low):
            return None
        out, at, changed = [], 0, False
        for m in _SEQUENCE.finditer(low):
            got = fix(m)
            ok = got != m.group() and _MIDWAY.fullmatch(got) and (wrong in _WIDE or not _IDEOGRAPHS.search(got))
            out += [token[at : m.start()], got if ok else token[m.start() : m.end()]]
            changed, at = changed or bool(ok), m.end()
        return "".join(out) + token[at:] if changed else None

    return decode


def _by_byte(wrong: str, right: str) -> Callable[[str], str | None]:
    """A token with each character replaced by that of the same byte; None if it cannot be."""
    to: dict[int, str] = {}
    for c, b in _table(wrong).items():
        try:
            to[ord(c)] = bytes([b]).decode(right)
        except UnicodeDecodeError:
            pass
    able = re.compile("[\x01-\x7f" + "".join(re.escape(chr(c)) for c in sorted(to)) + "]*")
    return lambda token: token.translate(to) if able.fullmatch(token) else None


def _images(wrong: str, right: str, chars: str) -> set[str]:
    """What characters are misread as, byte for byte."""
    back = {b: c for c, b in _table(wrong).items()}
    return {back[c.encode(right)[0]] for c in chars if c.encode(right)[0] in back}


#: A gate is a list of (class of the character that a search looks for, what must stand around it), the rarer character first.
_Gate = list[tuple[str, str]]


def _gate_utf8(wrong: str) -> _Gate:
    """The misread beginnings of the characters that a step may yield: first byte, and which second bytes go with it."""
    back: dict[int, str] = {}
    for c, b in _table(wrong).items():
        back[b] = back.get(b, "") + c
    seconds: dict[int, set[int]] = {}
    for cp in (*range(0xA0, 0x100), 0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, *range(0x400, 0x460), 0x490, 0x491, *range(0x2010, 0x203B), 0x20AC, 0x2116, 0x2122, *(range(0x3000, 0xA000, 64) if wrong in _WIDE else ())):
        data = chr(cp).encode()
        seconds.setdefault(data[0], set()).add(data[1])
    out: _Gate = []
    third = _cls("".join(back.get(b, "") for b in range(0x80, 0xC0)))
    for first, second in sorted(seconds.items()):
        lead, tail = back.get(first, ""), "".join(back.get(b, "") for b in second)
        more = third if first >= 0xE0 else ""
        if set(lead) & set(_LOWER):
            out.append((_cls(tail), f"(?<={_cls(lead)}{_cls(tail)}){more}"))
        elif lead and tail:
            out.append((_cls(lead), f"(?<={_cls(lead)}){_cls(tail)}{more}"))
    return out


def _gate_byte(wrong: str, right: str) -> _Gate:
    """Neighbours that misread words have and prose has not: a character foreign to words beside one that a small letter is
    misread as, a capital behind a small letter, three capitals, two accented letters, a dash that begins a word."""
    low, high = _images(wrong, right, _LOWER), _images(wrong, right, _LOWER.upper())
    odd, caps, latin = (low | high) - set(_KNOWN), low & set(_LOWER.upper()), {c for c in low if "À" <= c <= "ÿ"}
    out: _Gate = []
    if odd:
        out.append((_cls(odd), f"(?<={_cls(odd)})(?:(?<={_cls(low)}.)|{_cls(low)})"))
    if caps:
        out.append((_cls(caps), f"(?<=[{_LOWER}]{_cls(caps)})"))
        if len(caps) > 9:
            out.append((_cls(caps), f"(?<={_cls(caps)}){_cls(caps)}{{2}}"))
    if latin:
        out.append((_cls(latin), f"(?<={_cls(latin)}){_cls(latin)}"))
    if dashes := (low | high) & set("—–"):
        out.append((_cls(dashes), f"(?<={_cls(dashes)}){_cls(low)}{{2}}"))
    return out


def _pattern(gate: _Gate) -> re.Pattern:
    """One class to scan for, then what must stand around its character."""
    look = dict.fromkeys(rest for _, rest in gate)
    return re.compile("[" + "".join(dict.fromkeys(c[1:-1] for c, _ in gate)) + "](?:" + "|".join(look) + ")", re.DOTALL)


class _Chain:
    """One step or two. ``gain`` keeps, for each token met, (bytes saved, decoded), or None where the chain cannot explain it."""

    def __init__(self, steps: tuple[Callable[[str], str | None], ...], gate: _Gate, name: str):
        self.steps, self.gate, self.cost, self.name = steps, _pattern(gate), STEP_COST + FURTHER_COST * (len(steps) - 1), name
        self.looks = gate
        self.known: dict[str, tuple[float, str] | None] = {}

    def gain(self, token: str) -> tuple[float, str] | None:
        try:
            return self.known[token]
        except KeyError:
            pass
        if len(self.known) > KNOWN_TOKENS:
            self.known.clear()
        got: str | None = token
        for step in self.steps:
            got = step(got) if got is not None else None
        self.known[token] = out = None if got is None or got == token or not _MIDWAY.fullmatch(got) else (token_length(token) - token_length(got), got)
        return out


@functools.cache
def _chains() -> tuple[tuple[_Chain, ...], ...]:
    """All chains of one step and two, grouped by the first; at least one of two steps is a multi-byte one."""
    many = [(_by_utf8(w), _gate_utf8(w), w) for w in WRONG]
    single = [(_by_byte(w, r), _gate_byte(w, r), f"{w}>{r}") for w, r in SINGLE]
    out = []
    for step, gate, name in many + single:
        second = many + single if (step, gate, name) in many else many
        out.append((_Chain((step,), gate, name), *(_Chain((step, s), gate, f"{name}, {n}") for s, _, n in second)))
    return tuple(out)


@functools.cache
def _suspect() -> re.Pattern:
    return _pattern([("[�]", "(?<=�)"), *(x for group in _chains() for x in group[0].looks)])


@functools.cache
def _compressors() -> dict[str, zstd.ZstdCompressor]:
    out = {}
    for lang, text in PROSE.items():
        text = text.lower()
        words = text.split() if " " in text else [text[i : i + 8] for i in range(0, len(text), 8)]
        samples = [" ".join(words[i : i + n]).encode(ENCODING[lang], "tidemark-escape") for n in (1, 2, 5, 9) for i in range(0, len(words), max(1, n // 2))]
        try:
            d = zstd.train_dictionary(DICT_BYTES, samples * 3, level=6)
        except zstd.ZstdError:
            d = zstd.ZstdCompressionDict(text.encode(ENCODING[lang], "tidemark-escape"), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=6)
        out[lang] = zstd.ZstdCompressor(dict_data=d, level=6, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


_SYMBOL = "[─-▟√∙≈∆№€™†‡•¡-©¬-´¶¸-º¼-¿×÷\\xad\\x80-\\x9f]"
_STRAY = (re.compile(rf"(?<=[^\W\d_]){_SYMBOL}"), re.compile(rf"{_SYMBOL}(?=[^\W\d_])"), re.compile(r"\b[À-ÿ]{4,}\b"))
_UPPER = "A-ZÀ-ÖØ-ÞЀ-ЯҐ"
_SMALL = "a-zß-öø-ÿа-џґ"
_CASES = re.compile(rf"(?<![^\W_])(?:([{_UPPER}][{_SMALL}]+)|([{_UPPER}]{{2,}})|(?=[^\W_]*[{_SMALL}][^\W_]*[{_UPPER}]|[{_UPPER}]{{2}})[{_UPPER}{_SMALL}]{{2,}})(?![^\W_])")
_CYRILLIC, _CJK, _LATIN = re.compile("[Ѐ-ӿ]"), re.compile("[⺀-鿿豈-﫿＀-￯]"), re.compile("[A-Za-zÀ-ɏ]")


def _escape(e: UnicodeEncodeError) -> tuple[bytes, int]:
    return b"".join(b"\x1b" + c.encode("utf-8", "surrogatepass") for c in e.object[e.start : e.end]), e.end


codecs.register_error("tidemark-escape", _escape)


def _signs(text: str) -> float:
    """Bytes for capitals, which are told apart by word, and for symbols that stand beside letters."""
    capitals = sum(CAPITALS[(m.lastindex or 3) - 1] for m in _CASES.finditer(text))
    return capitals + STRAY * sum(len(p.findall(text)) for p in _STRAY)


def _languages(text: str) -> list[str]:
    """The languages whose script makes up a quarter of the letters of a text; the Latin ones if it has none of these scripts."""
    n = {k: len(p.findall(text)) for k, p in (("ru", _CYRILLIC), ("zh", _CJK), ("latin", _LATIN))}
    least = sum(n.values()) / 4
    by = [x for x in ("ru", "zh") if n[x] and n[x] >= least]
    return by + ["en", "de", "fr"] if n["latin"] and n["latin"] >= least or not by else by


def length(text: str) -> float:
    """Description length of a text in bytes: folded, in the byte encoding and under the dictionary of the best language whose
    script it holds (other characters are escaped), plus its capitals and strange symbols."""
    low, c = text.lower(), _compressors()
    return min(len(c[x].compress(low.encode(ENCODING[x], "tidemark-escape"))) for x in _languages(text)) + _signs(text)


@functools.cache
def _bigrams() -> dict[str, tuple[dict[str, float], dict[str, float]]]:
    """Per language the bits of a character, and of a character behind another, in the prose of the dictionaries."""
    out = {}
    for lang, text in PROSE.items():
        text = " " + re.sub(r"\s+", " ", text.lower()) + " "
        one, two = Counter(text), Counter(zip(text, text[1:]))
        n = len(text)
        single = {c: k / n for c, k in one.items()}
        pair = {a + b: -log2(0.7 * k / one[a] + 0.3 * single[b]) for (a, b), k in two.items()}
        out[lang] = {c: -log2(0.3 * p) for c, p in single.items()}, pair
    return out


@functools.lru_cache(maxsize=KNOWN_TOKENS)
def token_length(token: str) -> float:
    """Description length of one token in bytes, by pairs of characters: a token is too short for a compressor to tell."""
    low = f" {token.lower()} "
    best = float("inf")
    for lang in _languages(token):
        one, two = _bigrams()[lang]
        bits = 0.0
        for a, b in zip(low, low[1:]):
            got = two.get(a + b)
            bits += one.get(b, RARE_BITS) if got is None else got
        best = min(best, bits)
    return best / 8 + _signs(token)


ASCII = (0.0, "")
_ODD = re.compile(r"[\x80-\x9f]")
_BETWEEN = re.compile(r"([ \n/_\-]+)")


def _runs(parts: list[str], chain: _Chain) -> list[tuple[int, int, str, float]]:
    """The runs of tokens, as (first, past last, decoded, bytes saved) over parts, whose decoding saves most at RUN_COST each."""
    known = chain.known
    got = [ASCII if t.isascii() else known[t] if t in known else chain.gain(t) for t in parts[::2]]
    if sum(g[0] for g in got if g and g[0] > 0) <= RUN_COST:
        return []
    leave, inside = 0.0, float("-inf")
    steps: list[tuple[bool, bool]] = []  # the run goes on; leaving comes out of a run
    for g in got:
        came = inside > leave
        out = inside if came else leave
        if g is None:
            steps.append((False, came))
            leave, inside = out, float("-inf")
            continue
        on = inside >= leave - RUN_COST
        inside = (inside if on else leave - RUN_COST) + g[0]
        steps.append((on, came))
        leave = out
    done: list[tuple[int, int, str, float]] = []
    within, end = inside > leave, len(got)
    for i in range(len(got) - 1, -1, -1):
        on, came = steps[i]
        if within and not on:
            within, a, b = False, i, end
            while parts[2 * (b - 1)].isascii():
                b -= 1
            while parts[2 * a].isascii():
                a += 1
            after = "".join(parts[k] if k % 2 or got[k // 2] is ASCII else got[k // 2][1] for k in range(2 * a, 2 * b - 1))
            done.append((2 * a, 2 * b - 1, after, sum(g[0] for g in got[a:b])))
        elif not within and came:
            within, end = True, i
    return done


def _best(text: str, first: bool = False) -> tuple[str, float, _Chain] | None:
    """The decoding with the least description length and the bytes it saves, or None; with ``first`` any that saves some."""
    best: tuple[str, float, _Chain] | None = None
    parts = _BETWEEN.split(text)
    now = None
    for group in _chains():
        if not group[0].gate.search(text):
            continue
        for chain in group:
            runs = _runs(parts, chain)
            if not runs:
                continue
            out = list(parts)
            for a, b, after, _ in runs:
                out[a:b] = [after]
            after = "".join(out)
            if len(text) < SHORT:
                saved = sum(r[3] for r in runs)
            else:
                now = length(text) if now is None else now
                saved = now - length(after)
            saved -= chain.cost + RUN_COST * len(runs)
            if saved > 0 and (best is None or saved > best[1]):
                best = after, saved, chain
                if first:
                    return best
    return best


def repair(text: str | None) -> tuple[str | None, int, bool]:
    """(text, steps taken, garbled): the shortest description reached, and whether any part was or stays garbled."""
    if not text or not _suspect().search(text):
        return text, 0, False
    steps = rounds = 0
    while rounds < MOST_CHAINS and (got := _best(text)):
        text = got[0]
        steps += len(got[2].steps)
        rounds += 1
    return text, steps, steps > 0 or "�" in text


def is_garbled(text: str | None) -> bool:
    """Whether any part of a text is garbled; stops at the first chain that shortens it."""
    return bool(text) and _suspect().search(text) is not None and ("�" in text or _best(text, True) is not None)


def found(df: DataFrame) -> DataFrame:
    """(tab, row_key, text) -> (tab, row_key) of garbled texts; null and empty texts are never cases; repeated rows collapse."""

    def make():
        def each(tab, key, text):
            if is_garbled(text):
                yield tab, key

        return each

    return map_rows(df.select("tab", "row_key", "text"), make, "tab string, row_key string").dropDuplicates()


def restored(df: DataFrame) -> DataFrame:
    """(tab, row_key, text) -> garbled rows with the restored text, the steps and whether characters stay lost."""

    def make():
        def each(tab, key, text):
            got, steps, bad = repair(text)
            if bad:
                yield tab, key, got, steps, "�" in got or bool(_ODD.search(got))

        return each

    return map_rows(df.select("tab", "row_key", "text"), make, "tab string, row_key string, text string, steps int, lossy boolean").dropDuplicates()
