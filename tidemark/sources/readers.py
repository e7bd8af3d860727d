"""Sources: JSON-lines banks and corpora, documents of several formats, folders, dictionaries. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import html.parser
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T

PAIR = "wrong string, right string, rule string, definition string, section string"
CASE = "id string, kind string, text string, expected string, classes array<string>, note string"
BENCH = "id string, text string, clean boolean, must_contain array<string>, must_not_contain array<string>, must_response_contain array<string>, must_response_not_contain array<string>, category string, source string, context string, timeout double"
OUTER_QUOTES = "[«»\"„“”]"


def pair_bank(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines of wrong and right sentences -> (pair_id, PAIR columns).

    Blank lines, comment lines, invalid JSON, empty or equal pairs and pairs with an outer quote character are left out. Equal
    pairs of different lines both stay. pair_id is stable: file and line content hash.
    """
    raw = spark.read.text(list(paths)).select(F.trim("value").alias("value"), F.input_file_name().alias("file"))
    raw = raw.filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    p = raw.select("file", "value", F.from_json("value", PAIR).alias("p")).select("file", "value", "p.*")
    p = p.withColumns({"wrong": F.trim("wrong"), "right": F.trim("right")})
    ok = (F.length("wrong") > 0) & (F.length("right") > 0) & (F.col("wrong") != F.col("right")) & ~F.col("wrong").rlike(OUTER_QUOTES) & ~F.col("right").rlike(OUTER_QUOTES)
    return p.filter(ok).select(F.sha2(F.concat_ws("\n", "file", "value"), 256).alias("pair_id"), *(x.split()[0] for x in PAIR.split(", ")))


def eval_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Ragged JSON lines of evaluation cases; a missing expected text is the text."""
    return spark.read.schema(CASE).json(path).filter("id is not null").withColumn("expected", F.coalesce("expected", "text"))


def bench_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCH).json(path).filter("id is not null")


def user_dictionary(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """JSON {words: [...]} -> (word): valid words only; a corrupt file gives none."""
    w = spark.read.schema("words array<string>, updated_at string").option("multiLine", True).json(path).select(F.explode("words").alias("word"))
    return w.filter(T.valid_word(F.col("word"))).select(F.trim("word").alias("word")).distinct().orderBy(F.lower("word"), "word").limit(most)


# ---- documents -----------------------------------------------------------------------------------------------------------


def decode(data: bytes) -> str:
    """UTF-8, else Windows-1251, else UTF-16, else UTF-8 with replacements."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for codec in ("utf-8-sig", "cp1251"):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


class _Text(html.parser.HTMLParser):
    DROP = frozenset(("script", "style", "nav", "footer", "header", "noscript"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.DROP

    def handle_endtag(self, tag):
        self.depth -= tag in self.DROP and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def html_text(markup: str) -> str:
    """Visible text, one line for each run, without scripts, styles and page furniture."""
    p = _Text()
    p.feed(markup)
    p.close()
    return "\n".join(p.parts)


def rtf_text(data: str) -> str:
    """Text of a simple RTF file: control words and groups go, \\'XX is a byte of Windows-1251, \\par breaks a line."""
    data = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", data)
    data = re.sub(r"(?:\\'[0-9a-fA-F]{2})+", lambda m: bytes.fromhex(m.group().replace("\\'", "")).decode("cp1251", "replace"), data)
    data = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m.group(1)) % 65536), data)
    data = re.sub(r"\\(?:par|line)\b ?", "\n", data)
    data = re.sub(r"\\[a-zA-Z]+-?\d* ?", "", data)
    return re.sub(r"[{}]", "", data).replace("\\~", " ").strip()


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs, then the rows of tables with their cells between bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    run = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = [run(p) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        out += [" | ".join(run(c).strip() for c in row.findall(f"{_W}tc")) for row in table.findall(f"{_W}tr")]
    return "\n".join(x for x in out if x.strip())


def xlsx_rows(data: bytes) -> list[list[str]]:
    """Cells of the first sheet as text; missing cells are empty."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    rows = []
    for row in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{_S}row"):
        cells: list[str] = []
        for c in row.findall(f"{_S}c"):
            letters = re.match(r"[A-Z]+", c.get("r", "")) if c.get("r") else None
            at = 0
            for ch in letters.group() if letters else "":
                at = at * 26 + ord(ch) - 64
            while letters and len(cells) < at - 1:
                cells.append("")
            v = c.find(f"{_S}v")
            text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
            cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
        rows.append(cells)
    return rows


def read_bytes(name: str, data: bytes) -> str:
    """Text of one file by its extension; unknown ones raise."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind in ("txt", "md", "log"):
        return decode(data)
    if kind in ("htm", "html"):
        return html_text(decode(data))
    if kind == "rtf":
        return rtf_text(data.decode("latin-1"))
    if kind == "docx":
        return docx_text(data)
    if kind == "xlsx":
        return "\n".join(" | ".join(r) for r in xlsx_rows(data))
    raise ValueError(f"no reader for .{kind}")


def documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """All files under a folder -> (doc_id, file_hash, text, error). A file that cannot be read is a row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                try:
                    texts.append(read_bytes(path, data))
                    errors.append(None)
                except Exception as e:  # one broken file must not fail the scan
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "file_hash", "text", "error"])

    rel = F.substring_index("path", root + "/", -1)
    return files.select(rel.alias("doc_id"), F.sha2("content", 256).alias("file_hash"), "content").mapInArrow(run, "doc_id string, file_hash string, text string, error string")


def folder_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(doc_id, file_hash) of all files under a folder: the left side of a catalog diff."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.substring_index("path", folder.rstrip("/") + "/", -1).alias("doc_id"), F.sha2("content", 256).alias("file_hash"))
