"""Problem 7: evaluation items printed in training pages.

Method: a generalised suffix automaton over the words of the normalised test items. Pages are streamed through it word by
word in reading order, tracking the longest matching length; a match that is long enough and not a stock phrase (one whose
runs of RUN words all stand in many items) seeds its item, and every item that shares that run with it. For a seeded item
all common runs in the page around the seed are chained in order, gaps are filled with misread words, and the item leaked
if the chain covers enough of its words. Spans found that way can be cut from the page.

Only the items are held in memory, in blocks of at most BLOCK_ITEMS items; what counts as a stock phrase and the bits of a
run are computed over all items once, so that results do not depend on the blocks. The corpus is read once for each block,
is never shuffled, and only (item, page) rows leave a task.

Defined results: null and empty pages and items yield nothing; items with fewer than MIN_WORDS words leak only in full;
an item whose words carry fewer than SEED_BITS bits in all is a stock phrase and is never reported; items of equal words
count once for the stock limit and leak together; repeated rows collapse.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from math import log2

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_rows
from tidemark.llm.layout import BREAKS, line_order, reading_text

BLOCK_ITEMS, MOST_ITEMS = 4096, 1_000_000
#: Bits of a common run, under the word pairs of the items, from which chance no longer explains it (one run in about a thousand pages).
SEED_BITS = 33.0
STOCK_SHARE, STOCK_LEAST = 0.02, 4
#: Share of the words of the item, and of those between its first and last word found.
COVERAGE, DENSITY, MIN_WORDS = 0.5, 0.7, 8
MAX_GAP = 40
#: Words of the shortest run that can seed an item, and of the runs whose frequency tells stock phrases.
RUN = 4
KNOWN_WORDS = 200_000

_HYPHEN = re.compile(r"(?<=\w)[-‐‑](?=\w)")
_WORDS = re.compile(r"[^\W_]+")
_WORDS_HYPHEN = re.compile(r"[^\W_]+(?:[-‐‑][^\W_]+)*")


def words(text: str) -> list[str]:
    return _WORDS.findall(_HYPHEN.sub("", text).casefold())


def page_words(text: str, left: list[int] | None, right: list[int] | None, columns: int | None) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """The words of a page in reading order, as words(reading_text(...)) gives them, and where each stands in the page as it is."""
    out: list[str] = []
    places: list[list[tuple[int, int]]] = []
    broken = False
    for lo, hi in line_order(text, left, right, columns):
        for m in _WORDS_HYPHEN.finditer(text, lo, hi):
            word = "".join(_WORDS.findall(m.group().casefold()))
            if broken and m.start() == lo:
                out[-1] += word
                places[-1].append(m.span())
            else:
                out.append(word)
                places.append([m.span()])
            broken = False
        broken = hi > lo and text[hi - 1] in BREAKS and bool(places) and places[-1][-1][1] == hi - 1
    return out, places


@dataclass
class Statistics:
    """What is counted over all items: words, pairs of words, and in how many different items each run of RUN words stands."""

    one: Counter
    two: Counter
    runs: Counter
    items: int
    stock: int
    total: int


def statistics(texts: Iterable[str], stock: int | None = None) -> Statistics:
    seqs = {tuple(words(t)) for t in texts}
    runs = Counter(r for s in seqs for r in {s[i : i + RUN] for i in range(len(s) - RUN + 1)})
    return Statistics(
        Counter(w for s in seqs for w in s), Counter(x for s in seqs for x in zip(s, s[1:])), runs, len(seqs), max(STOCK_LEAST, int(STOCK_SHARE * len(seqs))) if stock is None else stock, sum(map(len, seqs))
    )


@dataclass
class Automaton:
    """Suffix automaton of several different word sequences, with the items that have each and where its states end."""

    items: list[tuple[tuple[str, ...], list[int]]]
    vocabulary: dict[str, int]
    step: list[dict[int, int]]
    link: list[int]
    length: list[int]
    own: list[list[tuple[int, int]]]
    below: list[list[int]]
    stands: list[list[bool]]
    shared: list[list[tuple[int, int, int, int]]] = field(default_factory=list)
    at: list[dict[int, list[int]]] = field(default_factory=list)
    first_bits: list[list[float]] = field(default_factory=list)
    sum_bits: list[list[float]] = field(default_factory=list)
    deletes: dict[str, list[str]] = field(default_factory=dict)
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def ends(self, state: int) -> Iterator[tuple[int, int]]:
        """(sequence, position) of the last word of each place at which the runs of a state stand."""
        todo = [state]
        while todo:
            v = todo.pop()
            yield from self.own[v]
            todo += self.below[v]

    def bits(self, k: int, start: int, n: int) -> float:
        return self.first_bits[k][start] + self.sum_bits[k][start + n] - self.sum_bits[k][start + 1]

    def read(self, word: str) -> tuple[int, ...]:
        """Item words that a page word stands for: itself, two run together, or the nearest within a few misread letters."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
                self.known.update({w: (i,) for w, i in self.vocabulary.items()})
            got = self.known[word] = self._guess(word)
        return got

    def _guess(self, word: str) -> tuple[int, ...]:
        v = self.vocabulary
        if word in v:
            return (v[word],)
        if len(word) >= 5 and not word.isdigit():
            for cut in range(2, len(word) - 1):
                if word[:cut] in v and word[cut:] in v:
                    return v[word[:cut]], v[word[cut:]]
            near = {w for d in _deletes(word) for w in self.deletes.get(d, ())}
            best = min((w for w in near if alike(word, w)), key=lambda w: (_distance(word, w), w), default=None)
            if best is not None:
                return (v[best],)
        return (-1,)


def _deletes(word: str) -> set[str]:
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out = {word} | one
    if len(word) >= 7:
        out |= {w[:i] + w[i + 1 :] for w in one for i in range(len(w))}
    return out


def _distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
    return row[-1]


def alike(x: str, y: str) -> bool:
    """Whether two words differ by misread letters only: one in a short word, two in one of seven letters and more."""
    n = max(len(x), len(y))
    return abs(len(x) - len(y)) <= 2 and _distance(x, y) <= (1 if n < 7 else 2)


def build(items: list[tuple[str, str]], stats: Statistics | None = None) -> Automaton:
    """The automaton of a block of items (id, text), under the statistics of all items (of these, if none are given)."""
    stats = stats or statistics(t for _, t in items)
    by_words: dict[tuple[str, ...], list[str]] = {}
    for i, t in items:
        by_words.setdefault(tuple(words(t)), []).append(i)
    vocabulary: dict[str, int] = {}
    seqs = [(tuple(ids), [vocabulary.setdefault(w, len(vocabulary)) for w in seq]) for seq, ids in by_words.items()]
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    own: list[list[tuple[int, int]]] = [[]]
    for k, (_, seq) in enumerate(seqs):
        last = 0
        for pos, w in enumerate(seq):
            q = step[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                own[last].append((k, pos))
                continue
            p, clone = last, None
            if q is not None:
                # The way exists but leads to longer runs only: a state of its own for the shorter ones, where this item ends.
                clone = _clone(step, link, length, own, last, w, q)
                last = clone
                own[last].append((k, pos))
                continue
            cur = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            own.append([(k, pos)])
            while p != -1 and w not in step[p]:
                step[p][w] = cur
                p = link[p]
            if p != -1:
                q = step[p][w]
                link[cur] = q if length[p] + 1 == length[q] else _clone(step, link, length, own, p, w, q)
            last = cur
    below: list[list[int]] = [[] for _ in step]
    for v in range(1, len(step)):
        below[link[v]].append(v)
    text = list(by_words)
    stands = [[stats.runs[s[i : i + RUN]] <= stats.stock for i in range(len(s) - RUN + 1)] for s in text]
    at = []
    for _, seq in seqs:
        places: dict[int, list[int]] = {}
        for pos, w in enumerate(seq):
            places.setdefault(w, []).append(pos)
        at.append(places)
    a = Automaton(seqs, vocabulary, step, link, length, own, below, stands, at=at)
    total = stats.total
    for s in text:
        a.first_bits.append([-log2(stats.one[w] / total) for w in s])
        then = [0.0] + [-log2(0.5 * stats.two[x, w] / stats.one[x] + 0.5 * stats.one[w] / total) for x, w in zip(s, s[1:])]
        a.sum_bits.append([0.0, *accumulate(then)])
    a.shared = _shared(a)
    for w in vocabulary:
        if len(w) >= 4 and not w.isdigit():
            for d in _deletes(w):
                a.deletes.setdefault(d, []).append(w)
    a.known.update({w: (i,) for w, i in vocabulary.items()})
    return a


def _clone(step, link, length, own, p: int, w: int, q: int) -> int:
    """Parts the shorter runs of state q, which follow state p by word w, from the longer ones."""
    c = len(step)
    step.append(dict(step[q]))
    link.append(link[q])
    length.append(length[p] + 1)
    own.append([])
    while p != -1 and step[p].get(w) == q:
        step[p][w] = c
        p = link[p]
    link[q] = c
    return c


def _shared(a: Automaton) -> list[list[tuple[int, int, int, int]]]:
    """For each sequence the maximal runs it has in common with others: (its position, other, position there, words).

    Found by runs of RUN words that are no stock phrase, so that a place meets at most as many others as the stock limit.
    """
    by_run: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for k, (_, seq) in enumerate(a.items):
        for i in range(len(seq) - RUN + 1):
            if a.stands[k][i]:
                by_run.setdefault(tuple(seq[i : i + RUN]), []).append((k, i))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in a.items]
    for k, (_, seq) in enumerate(a.items):
        last: dict[tuple[int, int], int] = {}  # (other, shift) -> the run last found there
        for i in range(len(seq) - RUN + 1):
            for other, o in by_run.get(tuple(seq[i : i + RUN]), ()):
                if other == k:
                    continue
                x = last.get((other, o - i))
                if x is not None and out[k][x][0] + out[k][x][3] == i + RUN - 1:
                    start, _, there, n = out[k][x]
                    out[k][x] = (start, other, there, n + 1)
                else:
                    last[other, o - i] = len(out[k])
                    out[k].append((i, other, o, RUN))
    return out


def seeds(a: Automaton, ids: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """Sequence -> (page position, item position, words) of maximal matches with enough information that are no stock phrase."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    step, link, length = a.step, a.link, a.length

    def add(k: int, page: int, pos: int, n: int) -> bool:
        if a.bits(k, pos, n) < SEED_BITS or not any(a.stands[k][pos : pos + n - RUN + 1]):
            return False
        out.setdefault(k, []).append((page, pos, n))
        return True

    def match(state: int, n: int, end: int) -> None:
        done: set[int] = set()
        while n >= RUN:
            for k, e in a.ends(state):
                if k in done:
                    continue
                start = e - n + 1
                if not add(k, end - n, start, n):
                    return  # too common or too short here, hence in all that have this run, and in its endings
                done.add(k)
                # Passages that other items have in common with this one stand on the page as well.
                for i, other, o, m in a.shared[k]:
                    lo, hi = max(i, start), min(i + m, e + 1)
                    if other not in done and hi - lo >= RUN:
                        add(other, end - n + lo - start, o + lo - i, hi - lo)
            state = link[state]
            n = length[state] if state > 0 else 0

    state = n = 0
    for j, w in enumerate(ids):
        nxt = step[state].get(w) if w >= 0 else None
        if nxt is not None:
            state, n = nxt, n + 1
            continue
        if n >= RUN:
            match(state, n, j)
        if w < 0:
            state = n = 0
            continue
        while state and w not in step[state]:
            state = link[state]
            n = length[state]
        nxt = step[state].get(w)
        state, n = (nxt, n + 1) if nxt is not None else (0, 0)
    if n >= RUN:
        match(state, n, len(ids))
    return out


def covered(a: Automaton, k: int, ids: list[int], found: list[tuple[int, int, int]]) -> tuple[float, int, int]:
    """(share of the words of the item, first and past-last page position) of the best chain of common runs by a seed.

    The share counts only if the chain is dense: within the part of the item that it spans, DENSITY of the words stand.
    """
    places, n = a.at[k], len(a.items[k][1])
    best = (0.0, 0, 0)
    done: list[tuple[int, int]] = []
    for page, pos, _ in sorted(found):
        if any(x <= page < y for x, y in done):
            continue
        lo, hi = max(0, page - pos * 2 - MAX_GAP), min(len(ids), page + (n - pos) * 2 + MAX_GAP)
        runs: list[tuple[int, int, int]] = []
        active: dict[int, tuple[int, int, int]] = {}
        for j in range(lo, hi):
            here = places.get(ids[j])
            if here is None:
                if active:
                    runs += [r for r in active.values() if r[2] > 1]
                    active = {}
                continue
            nxt: dict[int, tuple[int, int, int]] = {}
            for i in here:
                run = active.pop(i - 1, None)
                nxt[i] = (run[0], run[1], run[2] + 1) if run else (j, i, 1)
            if active:
                runs += [r for r in active.values() if r[2] > 1]
            active = nxt
        runs += [r for r in active.values() if r[2] > 1]
        runs.sort()
        score: list[float] = []
        back: list[int] = []
        for x, (j, i, m) in enumerate(runs):
            s, b = float(m), -1
            for y in range(x):
                jy, iy, my = runs[y]
                gj, gi = j - (jy + my), i - (iy + my)
                cut = max(0, -gj, -gi)  # runs that overlap are cut
                if gj + cut > MAX_GAP or cut >= m or iy >= i or jy >= j:
                    continue
                # Missing item words are dear; page words between are cheap, as adverts are.
                got = score[y] + m - cut - 0.6 * (gi + cut) - min(4.0, 0.15 * (gj + cut))
                if got > s:
                    s, b = got, y
            score.append(s)
            back.append(b)
        x = max(range(len(runs)), key=score.__getitem__)
        hit: set[int] = set()
        first = past = runs[x]
        while x >= 0:
            first = runs[x]
            hit.update(range(first[1], first[1] + first[2]))
            x = back[x]
        span = past[1] + past[2] - first[1]
        if len(hit) / n > best[0] and len(hit) >= DENSITY * span:
            best = len(hit) / n, first[0], past[0] + past[2]
        done.append((first[0], past[0] + past[2]))
    return best


def leaked(a: Automaton, tokens: list[str]) -> list[tuple[int, float, int, int]]:
    """(item, share, first word, past-last word) of the items that a page contains."""
    known, read = a.known, a.read
    ids: list[int] = []
    origin: list[int] = []
    for at, w in enumerate(tokens):
        got = known.get(w) or read(w)
        ids += got
        origin += [at] * len(got)
    out = []
    for k, found in seeds(a, ids).items():
        n = len(a.items[k][1])
        share, lo, hi = covered(a, k, ids, found)
        if share >= (COVERAGE if n >= MIN_WORDS else 1.0):
            out.append((k, share, origin[lo], origin[hi - 1] + 1))
    return out


_automata: dict[str, Automaton] = {}


def _cached(key: str, block: Broadcast) -> Automaton:
    """The automaton of a block, built once in each worker process."""
    if key not in _automata:
        while len(_automata) >= 2:
            _automata.pop(next(iter(_automata)))
        _automata[key] = build(*block.value)
    return _automata[key]


def _blocks(items: DataFrame) -> tuple[list[list[tuple[str, str]]], Statistics]:
    """The held-out items, at most BLOCK_ITEMS in memory of one worker at a time, and the statistics of them all. Test sets are
    what people write, at most MOST_ITEMS: more raise an error, as corpora never belong here."""
    rows = items.select("id", "text").filter("id is not null and length(text) > 0").distinct().limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} test items; pass a part of them at a time")
    rows = sorted((r[0], r[1]) for r in rows)
    return [rows[i : i + BLOCK_ITEMS] for i in range(0, len(rows), BLOCK_ITEMS)], statistics(t for _, t in rows)


def contaminated(pages: DataFrame, items: DataFrame) -> DataFrame:
    """pages (doc_id, text, line_boxes, n_columns), items (id, text) -> (item_id, doc_id, coverage, first_word, past_word)."""
    cols = pages.filter(F.length("text") > 0).select(
        "doc_id", "text", F.col("line_boxes.x0").alias("x0"), F.col("line_boxes.x1").alias("x1"), "n_columns"
    )
    out = None
    blocks, stats = _blocks(items)
    for block in blocks:
        needed = {w for _, t in block for w in words(t)}
        own = Statistics(Counter({w: n for w, n in stats.one.items() if w in needed}), Counter({x: n for x, n in stats.two.items() if needed.issuperset(x)}), Counter({r: n for r, n in stats.runs.items() if needed.issuperset(r)}), stats.items, stats.stock, stats.total)
        sent = cols.sparkSession.sparkContext.broadcast((block, own))  # at most BLOCK_ITEMS items

        def make(sent=sent, key=uuid.uuid4().hex):
            a = _cached(key, sent)

            def each(doc, text, x0, x1, n):
                # Places are looked up only where something is found.
                if not leaked(a, words(reading_text(text, x0, x1, n))):
                    return
                for k, share, lo, hi in leaked(a, page_words(text, x0, x1, n)[0]):
                    for item in a.items[k][0]:
                        yield item, doc, round(share, 4), lo, hi

            return each

        got = map_rows(cols, make, "item_id string, doc_id long, coverage double, first_word int, past_word int")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = cols.sparkSession.createDataFrame([], "item_id string, doc_id long, coverage double, first_word int, past_word int")
    return out.dropDuplicates()


def without_leaks(pages: DataFrame, items: DataFrame, most: float = 0.2) -> DataFrame:
    """(doc_id, text, leaked_words, words, action): pages without the leaked words; all else stays as it stands on the page.

    Spans are cut ('cut'); a page of which more than ``most`` leaked is dropped from training (text null, 'drop').
    """
    spans = contaminated(pages, items).groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "past_word")).alias("spans"))
    rows = pages.select("doc_id", "text", F.col("line_boxes.x0").alias("x0"), F.col("line_boxes.x1").alias("x1"), "n_columns").dropDuplicates(["doc_id"])
    rows = rows.join(spans, "doc_id", "left")

    def make():
        def each(doc, text, x0, x1, n, spans):
            if not spans or not text:
                yield doc, text, 0, None, "keep"
                return
            _, places = page_words(text, x0, x1, n)
            gone = sorted({w for s in spans for w in range(s["first_word"], min(s["past_word"], len(places)))})
            if len(gone) > most * len(places):
                yield doc, None, len(gone), len(places), "drop"
                return
            cuts = sorted(p for w in gone for p in places[w])
            kept, at = [], 0
            for k, (lo, hi) in enumerate(cuts):
                # What stands between two cut words that follow each other on the page goes with them.
                if k and not _WORDS.search(text, cuts[k - 1][1], lo):
                    at = hi
                    continue
                kept.append(text[at:lo])
                at = hi
            yield doc, "".join(kept) + text[at:], len(gone), len(places), "cut"

        return each

    return map_rows(rows.select("doc_id", "text", "x0", "x1", "n_columns", "spans"), make, "doc_id long, text string, leaked_words int, words int, action string")
