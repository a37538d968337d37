"""Documents from files, by extension."""

from __future__ import annotations

import io
import threading
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import extension, type_by_extension
from ..functions.text import html_text
from ..operators.scratch import cut
from .pdf import pdf_text

TEXT_EXTENSIONS, HTML_EXTENSIONS, BINARY_EXTENSIONS = (".txt", ".md", ".csv"), (".html", ".htm"), (".pdf", ".doc", ".docx")


def find_files(spark: SparkSession, folder: str, extensions: tuple = ()) -> DataFrame:
    """path, parent, name, extension, type, size and modification time of files below a folder; contents are not read."""
    path = F.col("path")
    kind = F.coalesce(type_by_extension(path), F.lit("UNKNOWN"))
    found = read_binary(spark, folder).select("path", F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"), extension(path).alias("extension"), kind.alias("type"), "length", "modificationTime")
    return found.filter(F.col("extension").isin(*extensions)) if extensions else found


def read_binary(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))


def loader_of(path: Column) -> Column:
    """text, html, pdf or word; text for what is not known."""
    ext = extension(path)
    return F.when(ext.isin(*HTML_EXTENSIONS), "html").when(ext == ".pdf", "pdf").when(ext.isin(".doc", ".docx"), "word").otherwise("text")


def docx_text(content: bytes) -> str:
    """The paragraphs of a .docx file."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def load_documents(spark: SparkSession, *paths: str, extractors: dict[str, Callable[[bytes], str]] | None = None, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """path, loader, text of each file. Text that does not decode, or a file whose extractor fails or is missing, gives an empty text.

    PDF and .docx files are read here, unless an extractor (extension to function of bytes) is given for them; .doc files need one.
    ``progress`` is called with the files done and all files whenever a task of the load ends, once ``load_documents`` has
    counted them; it then writes the texts to the shared folder, so that they are loaded once.
    """
    files = read_binary(spark, *paths).withColumn("loader", loader_of(F.col("path"))).withColumn("ext", extension(F.col("path")))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))
    plain = files.filter("loader in ('text', 'html')").select("path", "loader", F.when(F.col("loader") == "html", html_text(text)).otherwise(text).alias("text"))
    known = {".docx": docx_text, ".pdf": pdf_text, **(extractors or {})}

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ext, content in zip(pdf["ext"], pdf["content"]):
                try:
                    out.append(known[ext](bytes(content)))
                except Exception:  # a file that cannot be read is an empty document, as for every loader
                    out.append("")
            yield pd.DataFrame({"path": pdf["path"], "loader": pdf["loader"], "text": out})

    binary = files.filter("loader in ('pdf', 'word')").select("path", "loader", "ext", "content").mapInPandas(extract, "path string, loader string, text string")
    found = plain.unionByName(binary)
    return found if progress is None else _told(spark, found, files.count(), progress)


def _told(spark: SparkSession, found: DataFrame, n: int, progress: Callable[[int, int], None]) -> DataFrame:
    """``found``, written while ``progress`` is told of how many rows tasks are done with."""
    done, over = spark.sparkContext.accumulator(0), threading.Event()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf
            done.add(len(pdf))

    def watch() -> None:
        last = -1
        while True:
            ended = over.wait(0.2)
            if (now := min(done.value, n)) != last:
                progress(now, n)
                last = now
            if ended:
                return

    told = threading.Thread(target=watch)
    told.start()
    try:
        return cut(found.mapInPandas(counted, found.schema), "documents")
    finally:
        over.set()
        told.join()
