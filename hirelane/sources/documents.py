"""Document files: a landed folder of binaries to text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import file_type

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_type, content) of every file below a folder; a landing job fetches URLs, executors don't."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", file_type(F.lit(None).cast("string"), F.col("path")).alias("file_type"), "content")


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_W}t"))


def docx_text(content: bytes, cell_lines: bool = False) -> str:
    """Paragraphs, then table rows with their cells joined by " | " (or a line per cell)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = [_text(p) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        for row in table.iter(f"{_W}tr"):
            cells = [c for c in ("\n".join(_text(p) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")) if c]
            lines += cells if cell_lines else [" | ".join(cells)]
    return "\n".join(x for x in lines if x.strip()).strip()


def extract_docx(files: DataFrame, cell_lines: bool = False) -> DataFrame:
    """(path, text, method, warning) of the DOCX files; a broken file gives a warning and no text, never a failed job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, warnings = [], []
            for raw in b.column(1):
                try:
                    texts.append(docx_text(raw.as_py(), cell_lines))
                    warnings.append(None if texts[-1] else "No text was extracted from the DOCX document.")
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, TypeError) as e:
                    texts.append(None)
                    warnings.append(f"Failed to extract DOCX text: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(["DOCX_TEXT"] * len(texts)), pa.array(warnings, pa.string())], ["path", "text", "method", "warning"])

    return files.where("file_type = 'DOCX'").select("path", "content").mapInArrow(run, "path string, text string, method string, warning string")


def input_errors(df: DataFrame) -> DataFrame:
    """Rows that have neither text nor a link, or a link without name or type, with the reason."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    reason = F.when(~some("raw_text") & ~some("signed_url"), "raw_text or signed_url is required").when(some("signed_url") & ~some("raw_text") & ~(some("file_name") & some("file_type")), "file_name and file_type are required with signed_url")
    return df.withColumn("error", reason).where("error is not null")
