"""Reading files: size guards, type by content, dispatch, and parsers for text, tables and office formats."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions.rx import every, trim
from papyrion.functions.text import normalize_text

MAX_BYTES = 25 * 1024 * 1024
#: Endings that uploads may have, with their types.
ACCEPTED = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "txt": "text/plain",
    "md": "text/markdown",
    "csv": "text/csv",
    "tsv": "text/csv",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
}


def read(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``filename, size_bytes, content`` of files; oversized ones come without content, which :func:`parse` reports.

    The size filter reaches the scan, and the second scan asks for no content, so large files are never loaded.
    """
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    files = reader.load(path).withColumn("filename", F.substring_index("path", "/", -1)).withColumnRenamed("length", "size_bytes")
    large = files.where(F.col("size_bytes") > MAX_BYTES).select("filename", "size_bytes", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("size_bytes") <= MAX_BYTES).select("filename", "size_bytes", "content").unionByName(large)


def size_error(size: Column) -> Column:
    """Why a file is refused for its size, else null."""
    return F.when(size == 0, "empty").when(size < 10, "too small").when(size > MAX_BYTES, "too large")


def accepted(filename: Column) -> Column:
    """Whether an upload of this name is taken."""
    return F.lower(F.substring_index(filename, ".", -1)).isin(list(ACCEPTED))


def sniff(content: Column, fallback: Column) -> Column:
    """The type by the first bytes; what no rule knows keeps the type it came with."""
    head = F.hex(F.substring(content, 1, 12))
    starts = lambda x: F.startswith(head, F.lit(x))
    return (
        F.when(starts("25504446"), "application/pdf")
        .when(starts("89504E47"), "image/png")
        .when(starts("FFD8FF"), "image/jpeg")
        .when(starts("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.rlike("^504B0[357]"), "application/zip")
        .when(starts("474946"), "image/gif")
        .otherwise(fallback)
    )


def parser_of(mime: Column, filename: Column) -> Column:
    """Which parser takes a file, null if none does. Office formats tell apart by their names only."""
    ends = lambda x: filename.rlike(rf"(?i)\.(?:{x})\z")
    archive = mime == "application/zip"
    return (
        F.when(mime == "application/pdf", "pdf")
        .when(F.startswith(mime, F.lit("image/")), "image")
        .when(archive & ends("xlsx"), "xlsx")
        .when(archive & ends("docx"), "docx")
        .when(ends("csv") | (mime == "text/csv"), "csv")
        .when(ends("tsv"), "tsv")
        .when(mime.isin("text/plain", "text/markdown") | ends("txt|md|markdown"), "text")
    )


def html_headings(page: Column) -> Column:
    """Headings of a page in order as structs of heading and level, without markup; empty ones left out."""
    pattern = r"<(h[1-6])[^>]*>(.*?)</\1>"
    pairs = F.arrays_zip(every(page, pattern, "i", 1).alias("tag"), every(page, pattern, "i", 2).alias("body"))
    found = F.transform(pairs, lambda x: F.struct(trim(F.regexp_replace(x["body"], "<[^>]*>", "")).alias("heading"), F.substring(x["tag"], 2, 1).cast("int").alias("level")))
    return F.filter(found, lambda h: h["heading"] != "")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(data: bytes) -> tuple[str, list[tuple[str, int]]]:
    """Paragraphs of a word file joined by blank lines, and its headings with their levels."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    rows, heads = [], []
    for p in root.iter(f"{_W}p"):
        parts = ["\t" if e.tag == f"{_W}tab" else "\n" if e.tag == f"{_W}br" else e.text or "" for e in p.iter() if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")]
        text, style = "".join(parts), p.find(f"{_W}pPr/{_W}pStyle")
        rows.append(text)
        level = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(f"{_W}val", "")) if style is not None else None
        if level and text.strip():
            heads.append((text.strip(), int(level[1])))
    return "\n\n".join(rows), heads


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_text(data: bytes) -> str:
    """Every sheet as comma-separated lines below a banner with its name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            path = target[sheet.get(f"{_R}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    cells[_column(c.get("r", "")) if c.get("r") else len(cells)] = shared[int(text)] if c.get("t") == "s" else text
                line = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
                rows.append(",".join('"' + x.replace('"', '""') + '"' if re.search(r'[",\n]', x) else x for x in line))
            out.append(f"--- Sheet: {sheet.get('name')} ---\n" + "\n".join(rows))
    return "\n\n".join(out)


OFFICE = "doc_id long, text string, headings array<struct<heading:string,level:int>>, error string"


def office(files: DataFrame) -> DataFrame:
    """``files(doc_id, parser, content)`` of office formats -> text, headings and, for broken files, an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    text, heads = (xlsx_text(bytes(r.content)), []) if r.parser == "xlsx" else docx_text(bytes(r.content))
                    out.append((r.doc_id, text, [{"heading": h, "level": n} for h, n in heads], None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError) as e:
                    out.append((r.doc_id, None, [], f"{r.parser} parsing failed: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["doc_id", "text", "headings", "error"])

    return files.where(F.col("parser").isin("docx", "xlsx")).select("doc_id", "parser", "content").mapInPandas(run, OFFICE)


PARSED = ["doc_id", "filename", "mime", "size_bytes", "parser", "text", "tabular", "headings", "error"]


def parse(files: DataFrame, normalize: bool = True) -> DataFrame:
    """``files(doc_id, filename, size_bytes, content[, mime])`` -> one row per file with text or an error.

    A bad file gets an error and never fails the job. Images and page formats need decoded items: give
    them to :mod:`papyrion.operators.layout` and :mod:`papyrion.operators.ocr`.
    """
    named = F.col("mime") if "mime" in files.columns else F.lit("application/octet-stream")
    rows = files.withColumn("mime", sniff(F.col("content"), F.coalesce(named, F.lit("application/octet-stream"))))
    rows = rows.withColumns({"parser": parser_of(F.col("mime"), F.col("filename")), "error": size_error(F.col("size_bytes"))})
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("parser").isNull(), F.concat(F.lit("unsupported file type: "), F.col("mime"))).when(F.col("parser").isin("pdf", "image"), F.lit("needs decoded items"))))
    keep = ["doc_id", "filename", "mime", "size_bytes", "parser"]
    head = F.array().cast("array<struct<heading:string,level:int>>")
    plain = rows.where(F.col("error").isNotNull() | F.col("parser").isin("text", "csv", "tsv")).select(
        *keep, F.when(F.col("error").isNull(), F.decode("content", "UTF-8")).alias("text"), (F.col("error").isNull() & F.col("parser").isin("csv", "tsv")).alias("tabular"), head.alias("headings"), "error"
    )
    zipped = rows.where(F.col("error").isNull() & F.col("parser").isin("docx", "xlsx"))
    read_ = zipped.select(*keep).join(office(zipped), "doc_id").select(*keep, "text", F.lit(False).alias("tabular"), "headings", "error")
    out = plain.unionByName(read_)
    return out.withColumn("text", normalize_text(F.col("text"))) if normalize else out


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A delimited file with a header: all values stay text, empty ones are null."""
    return spark.read.options(header=True, sep=sep, inferSchema=False, multiLine=True, escape='"').csv(path)


def separator(parser: Column) -> Column:
    """A file named .tsv that came as text/csv is read with commas, as its type says."""
    return F.when(parser == "tsv", "\t").when(parser == "csv", ",")


def as_text_file(docs: DataFrame) -> DataFrame:
    """Extracted text as a plain text file again, to run the extraction anew."""
    return docs.withColumns({"filename": F.concat(F.regexp_replace("filename", r"\.[^.]*\z", ""), F.lit(".txt")), "mime": F.lit("text/plain"), "size_bytes": F.octet_length("text").cast("long")})
