"""Types and metadata of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types by extension.
BY_EXTENSION = {".txt": "TEXT", ".pdf": "PDF", ".doc": "WORD", ".docx": "WORD", ".html": "HTML", ".htm": "HTML", ".md": "MARKDOWN", ".markdown": "MARKDOWN", ".json": "JSON", ".xml": "XML", ".csv": "CSV"}
# Patterns that tell a content's type, its title and PDF fields.
JSON_LIKE = r"^\s*[\{\[][^\r\n]*[\}\]]\s*$"
CSV_LIKE = r"^[^,\r\n]*(?:,[^,\r\n]*)+(?:\r?\n[^,\r\n]*(?:,[^,\r\n]*)+)*$"
MARKDOWN_LIKE = r"^# |\n# |\n## |\n### |\n\* |\n- |\n```|\n> "
HEADING = r"(?:^|\n)#+\s+([^\n\r]+)(?:\n|$)"
TITLE = "<title>([^<]+)</title>"
H1 = "<h1[^>]*>([^<]+)</h1>"
META = r'<meta\s+(?:name|property)="([^"]+)"\s+content="([^"]+)"'
PDF_FIELDS = {"pdf_version": r"%PDF-(\d+\.\d+)", "title": r"/Title\s*\(([^)]+)\)", "author": r"/Author\s*\(([^)]+)\)", "creation_date": r"/CreationDate\s*\(([^)]+)\)", "modification_date": r"/ModDate\s*\(([^)]+)\)", "info_object": r"/Info\s+(\d+)\s+\d+\s+R"}


def extension(path: Column) -> Column:
    """The lower-cased extension of a path's file name with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """What a group of the first match holds; null if nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def type_by_extension(path: Column) -> Column:
    out = None
    ext = extension(path)
    for k, v in BY_EXTENSION.items():
        out = F.when(ext == k, v) if out is None else out.when(ext == k, v)
    return out


def document_type(content: Column, path: Column | None = None) -> Column:
    """The type by extension, else by content: PDF, HTML, XML, JSON, CSV, Markdown or text; UNKNOWN for an empty content."""
    commas = F.char_length(content) - F.char_length(F.replace(content, F.lit(","), F.lit("")))
    sniffed = (
        F.when(F.coalesce(content, F.lit("")) == "", "UNKNOWN")
        .when(content.startswith("%PDF"), "PDF")
        .when(content.contains("<!DOCTYPE html>") | content.contains("<html"), "HTML")
        .when(content.contains("<?xml"), "XML")
        .when(content.rlike(JSON_LIKE), "JSON")
        .when((commas > 5) & content.rlike(CSV_LIKE), "CSV")
        .when((content.contains("#") | content.contains("```")) & content.rlike(MARKDOWN_LIKE), "MARKDOWN")
        .otherwise("TEXT")
    )
    return sniffed if path is None else F.coalesce(type_by_extension(path), sniffed)


def character_count(c: Column) -> Column:
    """Bytes of the content."""
    return F.octet_length(c).cast("long")


def line_count(c: Column) -> Column:
    return (F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\w+")).cast("long")


def mixed_word_count(c: Column) -> Column:
    """Runs of ASCII letters and digits, and runs of Han characters."""
    return F.regexp_count(c, F.lit(r"[A-Za-z0-9]+|[\x{4e00}-\x{9fa5}]+")).cast("long")


def content_title(c: Column) -> Column:
    return F.coalesce(found(c, HEADING), found(c, TITLE), found(c, H1))


def content_metadata(c: Column) -> Column:
    """character_count, line_count, word_count and, if there is one, title; an empty map for empty content."""
    base = F.create_map(F.lit("character_count"), character_count(c).cast("string"), F.lit("line_count"), line_count(c).cast("string"), F.lit("word_count"), word_count(c).cast("string"))
    title = content_title(c)
    full = F.when(title.isNotNull(), F.map_concat(base, F.create_map(F.lit("title"), title))).otherwise(base)
    return F.when(F.coalesce(c, F.lit("")) != "", full).otherwise(F.create_map().cast("map<string,string>"))


def html_metadata(c: Column) -> Column:
    """title, h1 and each ``<meta name|property>`` as ``meta_`` and its name; of equal names the last counts."""
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(META), F.lit(1)).alias("k"), F.regexp_extract_all(c, F.lit(META), F.lit(2)).alias("v"))
    metas = F.transform(pairs, lambda p: F.struct(F.concat(F.lit("meta_"), p["k"]).alias("k"), p["v"].alias("v")))
    fixed = F.array(F.struct(F.lit("title").alias("k"), found(c, TITLE).alias("v")), F.struct(F.lit("h1").alias("k"), found(c, H1).alias("v")))
    entries = F.filter(F.concat(fixed, metas), lambda p: p["v"].isNotNull())
    last = F.filter(entries, lambda p, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def pdf_metadata(c: Column) -> Column:
    """Fields found anywhere in a PDF's content."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), found(c, p).alias("v")) for k, p in PDF_FIELDS.items()])
    return F.map_from_entries(F.filter(entries, lambda p: p["v"].isNotNull()))


def metadata_by_type(kind: Column, content: Column) -> Column:
    """Content metadata, and for HTML, PDF and Word their own; the type itself goes in as ``document_type``."""
    empty = F.create_map().cast("map<string,string>")
    own = F.when(kind == "HTML", html_metadata(content)).when(kind == "PDF", pdf_metadata(content)).when(kind == "WORD", F.create_map(F.lit("document_type_name"), F.lit("WORD"))).otherwise(empty)
    base = F.map_filter(content_metadata(content), lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return F.map_concat(base, own, F.create_map(F.lit("document_type"), kind))
