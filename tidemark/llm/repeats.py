"""Problem 5: lines repeated across the documents of one site.

Method: content-defined chunking. A rolling hash over the folded text (no case, digits or blanks) sets the piece borders, not
the line breaks; distinct documents are counted for each (site, piece) and pieces repeated excessively are found. A line
is then a candidate if every piece that lies wholly inside it, with the window that set its borders, is repeated; such
pieces depend on the line alone, so no repeated line is missed, and lines too short to hold one are candidates too. An
exact count of documents for each candidate (site, line) decides, and repeated lines are cut. without_pieces goes by pieces
alone, across line breaks: pieces repeated excessively are counted and cut by offset, so that notices whose lines were
wrapped anew go as well.

Only keys are shuffled, never text: 64 bits for documents, sites and lines, 32 for pieces, where a collision can only add a
candidate. Lines meet their site by document and salt; distinct (site, key, document) rows are made, then counted with a
map-side combine, so that neither a huge document nor a notice in every document of a huge site meets in one task.

Defined results: null text, and text without a repeated line, come back unchanged; lines of blanks are never cases; chunks
of unknown documents belong to no site and are left alone; repeated rows count once. What differs around a repeated passage
shares its first and last piece, so that up to a piece (about 32 characters) at either end of a passage stays.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_columns, map_rows, written

MIN_DOCUMENTS, MIN_SHARE = 4, 0.3
WINDOW, MASK = 6, 0x1F  # a border after every 32nd character, on average
#: Repeated pieces are broadcast up to this many rows (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: One document that holds a third of all chunks is spread over so many partitions.
SALTS = 16
_DROP = re.compile(r"[\d\s]+")
#: Pieces shorter than this say little; they are cut only between cut ones.
LEAST_PIECE = 12
_GEAR = np.random.default_rng(20240229).integers(1, 1 << 62, size=1 << 16, dtype=np.uint64)


def fold(line: str) -> str:
    return _DROP.sub("", line.casefold())


def line_key(folded: str) -> int:
    return xxhash.xxh3_64_intdigest(folded.encode("utf-8", "surrogatepass")) - (1 << 63)


def piece_key(piece: str) -> int:
    return xxhash.xxh32_intdigest(piece.encode("utf-8", "surrogatepass")) - (1 << 31)


def _borders(codes: np.ndarray) -> np.ndarray:
    """Where pieces end: behind each character at which the hash of the WINDOW characters up to it says so."""
    if len(codes) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    gear = _GEAR[codes & 0xFFFF]
    h = np.zeros(len(codes) - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        h += gear[WINDOW - 1 - k : len(codes) - k] << np.uint64(k)
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + WINDOW


def inner_pieces(lines: list[str]) -> list[list[int]]:
    """For each folded line the keys of its pieces: from one border of the rolling hash to the next, all within the line.

    The hash at a character covers the WINDOW characters up to it, so a border inside the line needs WINDOW of its
    characters; every line is hashed at once in one array.
    """
    out: list[list[int]] = [[] for _ in lines]
    joined = "\n".join(lines)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) < WINDOW:
        return out
    ends = _borders(codes)
    starts = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])]) if lines else []
    first = np.searchsorted(ends, np.asarray(starts) + WINDOW)
    last = np.searchsorted(ends, [s + len(x) for s, x in zip(starts, lines)], side="right")
    for i, (a, b) in enumerate(zip(first, last)):
        out[i] = [piece_key(joined[ends[k] : ends[k + 1]]) for k in range(a, b - 1)]
    return out


def text_pieces(text: str) -> list[tuple[int, int, int]]:
    """(key, start, end) of the pieces of a whole text, by offset. Folded characters keep the place of the one they come from."""
    low = text.casefold()
    if len(low) == len(text):
        at = None
    else:
        parts = [c.casefold() for c in text]
        low = "".join(parts)
        at = np.repeat(np.arange(len(text)), [len(x) for x in parts])
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kept = np.flatnonzero(_kept()[np.minimum(codes, 0xFFFF)])
    if not len(kept):
        return []
    codes, at = codes[kept], (kept if at is None else at[kept])
    data = codes.tobytes()
    cuts = [0, *(c for c in _borders(codes).tolist() if c < len(codes)), len(codes)]
    first, last = at[cuts[:-1]].tolist(), at[[c - 1 for c in cuts[1:]]].tolist()
    return [(xxhash.xxh3_64_intdigest(data[4 * a : 4 * b]) - (1 << 63), s, e + 1) for a, b, s, e in zip(cuts, cuts[1:], first, last)]


@functools.cache
def _kept() -> np.ndarray:
    """Which characters are neither digits nor blanks."""
    return np.array([not _DROP.match(chr(c)) for c in range(1 << 16)])


def lines_of(chunks: DataFrame) -> DataFrame:
    """(id, doc_id, text) -> (id, doc, line_no, line, pieces); lines of blanks are left out."""

    def make():
        def each(ids, docs, texts):
            got: list[tuple] = []
            folded: list[str] = []
            for i, d, t in zip(ids, docs, texts):
                for no, line in enumerate((t or "").split("\n")):
                    if line.strip():
                        f = fold(line)
                        got.append((i, d, no))
                        folded.append(f)
            if not got:
                return []
            a, b, c = zip(*got)
            return [list(a), list(b), list(c), [line_key(f) for f in folded], inner_pieces(folded)]

        return each

    cols = chunks.select("id", F.xxhash64("doc_id").alias("doc"), "text")
    return map_columns(cols, make, "id long, doc long, line_no int, line long, pieces array<int>")


def sites(documents: DataFrame) -> DataFrame:
    """(doc, site), one row a document, both as keys."""
    d = documents.filter("path is not null").select(F.xxhash64("doc_id").alias("doc"), F.xxhash64(F.substring_index("path", "/", 1)).alias("site"))
    return d.dropDuplicates(["doc"])


def _often(keys: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    """(site, by) groups that stand in enough documents of their site; documents are made distinct before they are counted."""
    n = keys.select("doc", "site", by).distinct().groupBy("site", by).agg(F.count("*").alias("n"))
    return n.filter(F.col("n") >= MIN_DOCUMENTS).join(totals, "site").filter(F.col("n") >= MIN_SHARE * F.col("total")).select("site", by, "n", "total")


def repeated_lines(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, site, line_no, line, n, total): lines repeated within their site, with the documents that hold them."""
    place = sites(documents)
    totals = place.groupBy("site").agg(F.count("*").alias("total"))
    salted = place.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = lines_of(chunks).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["doc", "salt"])
    hot = written(_often(lines.select("doc", "site", F.explode("pieces").alias("piece")), totals, "piece").select("site", "piece"), "pieces")
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    holds = lines.select("doc", "salt", "site", "id", "line_no", "line", F.explode_outer("pieces").alias("piece")).join(hot.withColumn("hot", F.lit(True)), ["site", "piece"], "left")
    whole = holds.groupBy("doc", "salt", "site", "id", "line_no", "line").agg(F.bool_and(F.col("piece").isNull() | F.coalesce("hot", F.lit(False))).alias("all_hot"))
    candidates = whole.filter("all_hot").select("doc", "site", "id", "line_no", "line")
    often = _often(candidates, totals, "line")
    return candidates.select("site", "id", "line_no", "line").distinct().join(often, ["site", "line"])


def without_repeats(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, doc_id, text, removed): every distinct chunk without its repeated lines, and how many were removed."""
    cut = repeated_lines(chunks, documents).groupBy("id").agg(F.collect_set("line_no").alias("cut"))
    rows = chunks.select("id", "doc_id", "text").dropDuplicates(["id"]).join(cut, "id", "left")

    def make():
        def each(i, doc, text, gone):
            if gone:
                gone = set(gone)
                text = "\n".join(x for no, x in enumerate(text.split("\n")) if no not in gone)
            yield i, doc, text, len(gone or ())

        return each

    return map_rows(rows.select("id", "doc_id", "text", "cut"), make, "id long, doc_id string, text string, removed int")


def repeated_pieces(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, nos): for each chunk that holds some the numbers of its pieces that are repeated within their site."""
    place = sites(documents)
    totals = place.groupBy("site").agg(F.count("*").alias("total"))
    salted = place.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def make():
        def each(i, doc, text):
            keys = [(no, k) for no, (k, s, e) in enumerate(text_pieces(text)) if e - s >= LEAST_PIECE]
            if keys:
                yield i, doc, keys

        return each

    rows = chunks.filter("text is not null").select("id", F.xxhash64("doc_id").alias("doc"), "text")
    held = map_rows(rows, make, "id long, doc long, pieces array<struct<no:int,piece:long>>").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    held = held.join(salted, ["doc", "salt"]).select("id", "doc", "site", F.explode("pieces").alias("p")).select("id", "doc", "site", "p.no", "p.piece")
    held = written(held, "held")
    hot = written(_often(held, totals, "piece").select("site", "piece"), "pieces")
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    return held.join(hot, ["site", "piece"]).groupBy("id").agg(F.collect_set("no").alias("nos"))


def cut_pieces(text: str, nos: set[int]) -> tuple[str, int]:
    """The text without the pieces of these numbers (and short ones between them), and the characters that went."""
    pieces = text_pieces(text)
    gone = [k in nos for k in range(len(pieces))]
    for k in range(1, len(pieces) - 1):
        gone[k] = gone[k] or gone[k - 1] and k + 1 in nos and pieces[k][2] - pieces[k][1] < LEAST_PIECE
    kept, at = [], 0
    for k, (_, start, end) in enumerate(pieces):
        if gone[k]:
            kept.append(text[at : start if not (k and gone[k - 1]) else at])
            at = end
    out = "".join(kept) + text[at:]
    return out, len(text) - len(out)


def without_pieces(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, doc_id, text, removed): every distinct chunk without its repeated pieces, and how many characters were removed."""
    rows = chunks.select("id", "doc_id", "text").dropDuplicates(["id"]).join(repeated_pieces(chunks, documents), "id", "left")

    def make():
        def each(i, doc, text, nos):
            text, gone = cut_pieces(text, set(nos)) if nos else (text, 0)
            yield i, doc, text, gone

        return each

    return map_rows(rows.select("id", "doc_id", "text", "nos"), make, "id long, doc_id string, text string, removed int")
