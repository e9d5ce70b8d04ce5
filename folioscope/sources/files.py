"""An inventory of files: kind by content, digest, year of the folder, and what could not be read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How files of a kind begin (hexadecimal), their mime type and category.
MAGIC = [
    ("25504446", "application/pdf", "pdf"),
    ("FFD8FF", "image/jpeg", "image"),
    ("89504E470D0A1A0A", "image/png", "image"),
    ("49492A00", "image/tiff", "image"),
    ("4D4D002A", "image/tiff", "image"),
    ("47494638", "image/gif", "image"),
    ("424D", "image/bmp", "image"),
    ("504B0304", "application/zip", "zip"),
    ("D0CF11E0A1B11AE1", "application/x-ole-storage", "legacy_office"),
]
SYSTEM_FILES = (".DS_Store", "Thumbs.db", "desktop.ini", "._*")
TEXT_ROUTE = 100  # characters that make a page text
GARBLED = 0.1


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, size, modified, content of every file under a folder; links are not followed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content"
    )


def folder_year(path: Column, this_year: int | None = None) -> Column:
    """The year that the nearest enclosing folder names, 1900 to this year."""
    folders = F.reverse(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))))
    years = F.transform(folders, lambda p: F.regexp_extract(p, r"(?<!\d)((?:19|20)\d\d)(?!\d)", 1).try_cast("int"))
    fit = F.filter(years, lambda y: y.isNotNull() & (y <= (this_year or date.today().year)))
    return F.when(F.size(fit) > 0, fit[0])


def kind_of(content: Column, name: Column) -> Column:
    """struct(mime, category) by the first bytes, then, for texts, by whether they decode."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for magic, mime, category in MAGIC:
        what = F.struct(F.lit(mime).alias("mime"), F.lit(category).alias("category"))
        if category == "zip":
            office = F.when(F.lower(name).endswith(".docx"), "word").when(F.lower(name).endswith(".xlsx"), "excel").otherwise("zip")
            what = F.struct(F.lit(mime).alias("mime"), office.alias("category"))
        test = head.startswith(magic)
        out = F.when(test, what) if out is None else out.when(test, what)
    text = F.is_valid_utf8(content.cast("string")) & ~F.contains(F.hex(F.substring(content, 1, 4096)), F.lit("0000"))
    plain = F.struct(F.lit("text/plain").alias("mime"), F.lit("text").alias("category"))
    other = F.struct(F.lit("application/octet-stream").alias("mime"), F.lit("unknown").alias("category"))
    return out.when(text, plain).otherwise(other)


def http_body(content: bytes) -> int:
    """Where the body begins in a file saved as a raw HTTP response; 0 for any other file."""
    if not content[:5] == b"HTTP/":
        return 0
    ends = [at + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := content.find(mark, 0, 65_536)) >= 0]
    return min(ends, default=0)


def inventory(files: DataFrame, this_year: int | None = None) -> DataFrame:
    """One row a file: path, name, size, folder_year, skipped, sha256, mime, category, parts, error.

    A system's own files are noted and not read; what a probe cannot open becomes its error and
    never an exception.
    """
    skipped = F.when(F.col("name").isin(*SYSTEM_FILES[:-1]) | F.col("name").startswith("._"), "system file")
    rows = files.withColumn("skipped", skipped).withColumn("kind", kind_of(F.col("content"), F.col("name")))
    rows = rows.select(
        "path", "name", "size", folder_year(F.col("path"), this_year).alias("folder_year"), "skipped",
        F.when(skipped.isNull(), F.sha2("content", 256)).alias("sha256"), "kind.mime", "kind.category", "content",
    )

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = [_probe(c, bytes(x)) if s is None else (None, None) for c, x, s in zip(part["category"], part["content"], part["skipped"])]
            part["parts"] = pd.array([a for a, _ in answers], dtype="Int32")
            part["error"] = [b for _, b in answers]
            yield part.drop(columns="content")

    return rows.mapInPandas(probe, "path string, name string, size long, folder_year int, skipped string, sha256 string, mime string, category string, parts int, error string")


def _probe(category: str, content: bytes) -> tuple[int | None, str | None]:
    """Pages, sheets or pictures of a file, and why it could not be opened."""
    try:
        if not content:
            return None, "empty file"
        content = content[http_body(content) :]
        if category == "pdf":
            pages = content.count(b"/Type /Page") + content.count(b"/Type/Page") - content.count(b"/Type /Pages") - content.count(b"/Type/Pages")
            return (pages, None) if b"%%EOF" in content[-2048:] else (None, "damaged file")
        if category in ("word", "excel", "zip"):
            names = zipfile.ZipFile(io.BytesIO(content)).namelist()
            inner = [n for n in names if n.startswith(("xl/worksheets/", "word/media/", "xl/media/"))]
            return len(inner), None
        return 1, None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"[:200]


def looks_garbled(text: Column) -> Column:
    """Whether over a tenth of a text is replacement signs, private letters or control characters."""
    bad = F.length(text) - F.length(F.regexp_replace(text, r"[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0E-\x1F]", ""))
    return (F.length(text) > 0) & (bad / F.length(text) > GARBLED)


def route(text: Column) -> Column:
    """text for a page with enough sound text, else vision."""
    return F.when((F.length(F.trim(F.coalesce(text, F.lit("")))) >= TEXT_ROUTE) & ~looks_garbled(text), "text").otherwise("vision")


ENCODINGS = ("utf-8", "cp1251", "cp1253", "cp1252", "koi8-r")


def decode_text(content: bytes) -> str:
    """A text file of unknown coding: marks first, UTF-8 if it fits, else what yields most letters
    in lower case, which is what prose is made of."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        guesses = [content.decode(name, "replace") for name in ENCODINGS[1:]]
        return max(guesses, key=lambda t: sum((c.isalpha() and c.islower()) - 2 * (c == "�" or not c.isprintable() and not c.isspace()) for c in t))


def text_file_pages(files: DataFrame, most: int = 5000) -> DataFrame:
    """(path, page, text) of text files, cut at line ends."""
    from ..functions.text import text_pages

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "text": [decode_text(bytes(x)) for x in part["content"]]})

    texts = files.select("path", "content").mapInPandas(work, "path string, text string")
    return texts.select("path", F.posexplode(text_pages(F.col("text"), most)).alias("page", "text"))


def office_text(files: DataFrame, most_rows: int = 200) -> DataFrame:
    """(path, part, text, rows_left_out): paragraphs of Word files and rows of Excel sheets, by tabs, up to
    `most_rows` rows a sheet; rows_left_out says how many a sheet has beyond.  A file that does not
    open gives no part; the inventory has its error."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, k, t, left) for p, x in zip(part["path"], part["content"]) for k, (t, left) in enumerate(_office(bytes(x), most_rows))]
            yield pd.DataFrame(rows, columns=["path", "part", "text", "rows_left_out"])

    return files.select("path", "content").mapInPandas(work, "path string, part int, text string, rows_left_out int")


def _office(content: bytes, most_rows: int) -> list[tuple[str, int]]:
    import re
    from xml.etree import ElementTree

    local = lambda e: e.tag.rpartition("}")[2]
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = book.namelist()
        if "word/document.xml" in names:
            body = ElementTree.fromstring(book.read("word/document.xml"))
            lines = ["".join(t.text or "" for t in p.iter() if local(t) == "t") for p in body.iter() if local(p) == "p"]
            return [("\n".join(x for x in lines if x), 0)]
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(s) == "si"]
        out = []
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
            rows = [r for r in ElementTree.fromstring(book.read(name)).iter() if local(r) == "row"]
            lines = ["\t".join(_cell(c, shared, local) for c in r if local(c) == "c") for r in rows[:most_rows]]
            out.append(("\n".join(lines), max(0, len(rows) - most_rows)))
        return out
    except Exception:
        return []


def _cell(cell, shared: list[str], local) -> str:
    text = "".join(v.text or "" for v in cell.iter() if local(v) in ("v", "t"))
    return shared[int(text)] if cell.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text
