"""Scans: uploaded files, the texts of which become rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sections, upload_name

#: Fixed value: fewer characters than this from a PDF's text layer mean that it is a scan.
LEAST_PDF_TEXT = 100
NO_TEXT = "no text could be extracted from this PDF"
PdfReader = Callable[[bytes], str]


def plain_text(content: bytes) -> str:
    """UTF-8 without the bytes that are none, line ends as newlines."""
    return content.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def json_text(content: bytes) -> str:
    """A JSON document written anew with an indent of two."""
    return json.dumps(json.loads(content.decode("utf-8")), indent=2)


def pdf_text(content: bytes, readers: Sequence[PdfReader], ocr: PdfReader | None = None) -> str:
    """The first text of ``LEAST_PDF_TEXT`` characters that a reader finds, else any that OCR does; raises without one."""
    for read in readers:
        text = read(content)
        if text and len(text) >= LEAST_PDF_TEXT:
            return text
    text = ocr(content) if ocr else ""
    if not text:
        raise ValueError(NO_TEXT)
    return text


def read_uploads(
    spark: SparkSession, path: str, pattern: str = "*", pdf_readers: Sequence[PdfReader] | None = None, ocr: PdfReader | None = None
) -> DataFrame:
    """Files as (source_file, upload_name, upload_hash, text, error, sections, suffix, section_count).

    JSON is written anew, PDFs go through ``pdf_readers`` and then ``ocr`` (those of
    ``pdf`` that are installed, if not given), everything else is UTF-8 text.  A file that
    cannot be read has no text and its ``error`` says why.
    """
    from . import pdf

    readers = list(pdf.installed() if pdf_readers is None else pdf_readers)
    scan = pdf.ocr_reader() if ocr is None and pdf_readers is None else ocr

    @F.pandas_udf("text string, error string")
    def parse(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
        def one(kind: str, raw: bytes) -> tuple[str | None, str | None]:
            try:
                if kind == ".pdf":
                    return pdf_text(raw, readers, scan), None
                return (json_text(raw) if kind == ".json" else plain_text(raw)), None
            except Exception as e:  # any reader's failure is the file's, not the job's
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(k, c) for k, c in zip(suffix, content, strict=True)], columns=["text", "error"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = raw.select(
        name.alias("source_file"), upload_name(name, F.col("content")).alias("upload_name"), F.sha2("content", 256).alias("upload_hash"),
        F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)).alias("suffix"), "content",
    )
    rows = rows.withColumn("parsed", parse("suffix", "content")).select("source_file", "upload_name", "upload_hash", "suffix", "parsed.text", "parsed.error")
    return rows.withColumn("sections", sections(F.col("text"))).withColumn("section_count", F.size("sections"))
