"""Problem 4: splitting oversized items at natural boundaries.

Method: byte-range processing. Workers detect boundaries in ranges with halos, boundary tables are stitched, lengths are
prefix-summed, and pieces are emitted by offset. split_files does this for files of any size without loading one whole:
each range finds its own first border and that of the next range from its halo, so neighbours agree without talking, and
only one summary row a range is shuffled. Files are read through Arrow's file systems (mounted folders, HDFS, object stores).
split_rows applies the same to texts that are rows: boundaries and unbroken runs are found range by range and stitched.

Rules: a piece has at most ``limit`` code points; a cut is put behind the strongest boundary in the second half of the
piece (line break, then sentence end, then clause mark, then blank; the latest of equals), or behind the latest in the first
half if the second has none; where an unbroken run leaves no boundary behind the overlap the cut is hard. Each piece but the first starts exactly ``overlap`` code points before the end of the one before.

Defined results: null and empty texts and texts within the limit come back as one piece; a null limit or overlap takes the
default; pieces with a null doc_id or chunk_id are numbered among themselves; a limit below 1 counts as 1, an overlap of the
limit or more as one less, so that every piece makes progress; bytes that are no UTF-8 count as one character (U+FFFD) each.
"""

from __future__ import annotations

import re as stdlib_re

import pyarrow.fs as arrow_fs
import regex as re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.arrow import map_rows, written

LIMIT, OVERLAP = 1200, 150
#: Characters of a range of a text that is a row, and of its halo.
RANGE, HALO = 1 << 11, 256
ID_BLOCK = 256
MOST_TASKS = 50_000

_BOUNDARY = re.compile(
    r"(?P<line>\n+)|(?P<sentence>[.!?…]+[»”\"')\]]*\s+(?=[^\s\p{Ll}\d])|[。！？]+[」』”’）]*|[।؟]\s*)|(?P<clause>[;:,،؛]\s+|\s[—–-]\s|[，；：、])|(?P<blank>\s+)"
)
_STRENGTH = {"line": 4, "sentence": 3, "clause": 2, "blank": 1}
_RUN = re.compile(r"[\p{L}\p{N}]+")


def boundaries(text: str, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    """(offset behind the boundary, strength) with lo < offset <= hi."""
    hi = len(text) if hi is None else hi
    return [(m.end(), _STRENGTH[m.lastgroup]) for m in _BOUNDARY.finditer(text, lo, min(len(text), hi + 1)) if lo < m.end() <= hi]


def in_ranges(text: str, size: int = RANGE, halo: int = HALO) -> list[tuple[int, int]]:
    """The boundary table of a long text, range by range; equals boundaries(text) where no boundary is longer than the halo."""
    if len(text) <= size:
        return boundaries(text)
    out: dict[int, int] = {}
    for lo in range(0, len(text), size):
        base = max(0, lo - halo)
        part = text[base : min(len(text), lo + size + halo)]
        out |= {base + o: s for o, s in boundaries(part) if lo < base + o <= lo + size}
    return sorted(out.items())


def settings(limit: int | None, overlap: int | None) -> tuple[int, int]:
    limit = max(1, LIMIT if limit is None else limit)
    return limit, min(max(0, OVERLAP if overlap is None else overlap), limit - 1)


def choose(table: list[tuple[int, int]], n: int, limit: int, overlap: int, start: int = 0) -> list[tuple[int, int, bool]]:
    """Pieces (start, end, hard) that cover start..n, chosen greedily over a sorted boundary table."""
    out: list[tuple[int, int, bool]] = []
    s, i = start, 0
    while n - s > limit:
        least, most = s + max(limit // 2, overlap + 1), s + limit
        while i < len(table) and table[i][0] < least:
            i += 1
        best, j = None, i
        while j < len(table) and table[j][0] <= most:
            if best is None or table[j][1] >= best[1]:
                best = table[j]
            j += 1
        if best is None and i and table[i - 1][0] > s + overlap:
            best = table[i - 1]
        e = best[0] if best else most
        out.append((s, e, best is None))
        s = e - overlap
    out.append((s, n, False))
    return out


def longest_run(text: str, size: int = RANGE) -> int:
    """The longest unbroken run of letters and digits: each range tells its first, longest and last run, which are stitched."""
    best = open_ = 0  # open_: the run that reaches the end of the ranges so far
    for lo in range(0, len(text), size):
        hi = min(len(text), lo + size)
        runs = [m.span() for m in _RUN.finditer(text, lo, hi)]
        if runs and runs[0] == (lo, hi):
            open_ += hi - lo
        else:
            first = runs[0][1] - lo if runs and runs[0][0] == lo else 0
            best = max([best, open_ + first, *(b - a for a, b in runs)])
            open_ = hi - runs[-1][0] if runs and runs[-1][1] == hi else 0
    return max(best, open_)


def split_rows(items: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, text, chunk_chars, overlap) -> (doc_id, chunk_id, piece, start_pos, text, cut); narrow.

    cut is null for an item within its limit, else 'hard' if it holds an unbroken run longer than the limit, else 'soft'.
    """

    def make():
        def each(doc, chunk, text, limit, overlap):
            limit, overlap = settings(limit, overlap)
            if text is None or len(text) <= limit:
                yield doc, chunk, 0, 0, text, None
                return
            cut = "hard" if longest_run(text) > limit else "soft"
            for k, (s, e, _) in enumerate(choose(in_ranges(text), len(text), limit, overlap)):
                yield doc, chunk, k, s, text[s:e], cut

        return each

    cols = items.select("doc_id", "chunk_id", "text", "chunk_chars", "overlap")
    return map_rows(cols, make, "doc_id string, chunk_id int, piece int, start_pos int, text string, cut string")


def with_limits(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct chunks with the limits of their document (null where the document is unknown)."""
    return _limited(chunks, documents).dropDuplicates(["id"])


def _limited(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    limits = documents.select("doc_id", "chunk_chars", "overlap").dropDuplicates(["doc_id"])
    return chunks.select("id", "doc_id", "chunk_id", "text").join(limits, "doc_id", "left")


def oversized(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct chunks over their limit. Texts within the least limit of all never leave the scan."""
    limit = F.greatest(F.coalesce("chunk_chars", F.lit(LIMIT)), F.lit(1))
    least = documents.agg(F.coalesce(F.least(F.min(limit), F.lit(LIMIT)), F.lit(LIMIT))).scalar()
    some = chunks.filter(F.length("text") > least)
    return _limited(some, documents).filter(F.length("text") > limit).dropDuplicates(["id"])


def renumber(pieces: DataFrame) -> DataFrame:
    """New chunk_id (0-based over the document) and chunks (pieces of the document).

    A two-level prefix sum: piece counts by (document, block of chunk_id), summed over the blocks, then within a block. One
    document that holds a third of all chunks is spread over its blocks.
    """
    # Null keys as values that no other key has, so that plain equality joins them and pieces are shuffled once.
    block = F.coalesce(F.floor(F.col("chunk_id") / ID_BLOCK).cast("long"), F.lit(-1 << 40))
    doc = ["doc", "unknown"]
    p = pieces.withColumns({"doc": F.coalesce("doc_id", F.lit("")), "unknown": F.col("doc_id").isNull(), "block": block})
    n = p.groupBy(*doc, "block").agg(F.count("*").alias("n"))
    over = Window.partitionBy(*doc).orderBy("block")
    base = n.select(
        *doc,
        "block",
        (F.sum("n").over(over) - F.col("n")).alias("base"),
        F.sum("n").over(Window.partitionBy(*doc)).alias("chunks"),
    )
    within = F.row_number().over(Window.partitionBy(*doc, "block").orderBy("chunk_id", "piece"))
    return (
        p.withColumn("k", within)
        .join(base, [*doc, "block"])
        .select("doc_id", F.col("chunk_id").alias("old_chunk_id"), (F.col("base") + F.col("k") - 1).cast("int").alias("chunk_id"), F.col("chunks").cast("int").alias("chunks"), "start_pos", "text", "cut")
    )


# ---- files -----------------------------------------------------------------------------------------------------------


def _read(path: str, lo: int, hi: int) -> bytes:
    system, name = arrow_fs.FileSystem.from_uri(path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    with system.open_input_file(name) as f:
        f.seek(lo)
        return f.read(hi - lo)


def _decode(data: bytes) -> str:
    """Bytes that are no UTF-8 as one lone surrogate each, so that lengths in bytes are not lost; _shown makes them U+FFFD."""
    return data.decode("utf-8", "surrogateescape")


def _n_bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


_LOST = stdlib_re.compile("[\udc80-\udcff]")


def _shown(text: str) -> str:
    return _LOST.sub("�", text)


def _start_of_char(data: bytes, at: int) -> int:
    """The start of the next character, at most three bytes on: longer runs of tail bytes are no characters."""
    end = min(len(data), at + 3)
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _border(data: bytes, at: int, reach: int) -> int:
    """The border of a range: behind the strongest, then first, boundary within reach; the next character if there is none."""
    at = _start_of_char(data, at)
    end = min(len(data), at + reach)
    text = _decode(data[at : end if end == len(data) else _start_of_char(data, end)])
    best = max(boundaries(text), key=lambda b: (b[1], -b[0]), default=None)
    return at + _n_bytes(text[: best[0]]) if best else at


def split_files(spark: SparkSession, folder: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 8 << 20) -> DataFrame:
    """UTF-8 files in a folder that all workers see (and its subfolders) -> (path, piece, byte_start, char_start, text).

    One task holds one range and its halos. A range summary (its pieces and characters) is all that is shuffled; the pieces are
    written once, so that ranges are not cut again for their summaries.
    """
    limit, overlap = settings(limit, overlap)
    reach, back = 4 * limit + HALO, 4 * overlap + HALO
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size")).filter("size > 0")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / range_bytes))).alias("r"))
    # The number is given, or the few bytes of these rows would be put into one task.
    n = files.agg(F.sum(F.floor((F.col("size") - 1) / range_bytes) + 1).cast("int")).first()[0] or 1
    ranges = ranges.repartition(min(n, MOST_TASKS), "path", "r")

    def make():
        def each(path, size, r):
            lo = r * range_bytes
            base = max(0, lo - back)
            data = _read(path, base, min(size, lo + range_bytes + reach))
            a = 0 if r == 0 else _border(data, lo - base, reach)
            b = len(data) if lo + range_bytes >= size else _border(data, lo + range_bytes - base, reach)
            head = _decode(data[_start_of_char(data, 0) : a]) if r else ""
            body = _decode(data[a:b])
            lead = head[-overlap:] if overlap else ""
            text = lead + body
            chars = len(body)
            at, at_byte = 0, base + a - _n_bytes(lead)
            if not body:
                yield path, r, 0, at_byte, 0, chars, None
                return
            for k, (s, e, _) in enumerate(choose(in_ranges(text), len(text), limit, overlap)):
                at_byte += _n_bytes(text[at:s]) if s >= at else -_n_bytes(text[s:at])
                at = s
                yield path, r, k, at_byte, s - len(lead), chars, _shown(text[s:e])

        return each

    pieces = written(map_rows(ranges, make, "path string, r long, k int, byte_start long, char_in_range long, chars long, text string"), "pieces")
    per = pieces.groupBy("path", "r").agg(F.max("chars").alias("chars"), F.count("text").alias("n"))
    w = Window.partitionBy("path").orderBy("r")  # one row a range
    base = per.select("path", "r", (F.sum("n").over(w) - F.col("n")).alias("piece0"), (F.sum("chars").over(w) - F.col("chars")).alias("char0"))
    return (
        pieces.filter("text is not null")
        .join(base, ["path", "r"])
        .select("path", (F.col("piece0") + F.col("k")).alias("piece"), "byte_start", (F.col("char0") + F.col("char_in_range")).alias("char_start"), "text")
    )
