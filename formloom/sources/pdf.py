"""Readers of PDF bytes, each where its library is installed; words of pages with their places."""

from __future__ import annotations

import importlib.util
import io
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

#: Least confidence of a recognised word, and how much larger than its points a page is drawn for recognition.
LEAST_CONFIDENCE = 30
SCALE = 2.0
WORDS = "page_number int, page_width double, page_height double, text string, x0 double, top double, x1 double, bottom double"


def _has(*modules: str) -> bool:
    return all(importlib.util.find_spec(m) is not None for m in modules)


def read_partitions(content: bytes) -> str:
    """Text of the parts that a layout partitioner finds, a line each; empty where it fails."""
    from unstructured.partition.pdf import partition_pdf

    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:  # the task's own scratch file
        f.write(content)
        f.flush()
        try:
            return "\n".join(str(part) for part in partition_pdf(filename=f.name) if str(part).strip())
        except Exception:
            return ""


def read_text_layer(content: bytes) -> str:
    """Text of each page, pages apart by a blank line; a broken file raises."""
    from pypdf import PdfReader

    return "\n\n".join((page.extract_text() or "").strip() for page in PdfReader(io.BytesIO(content)).pages).strip()


def read_layout(content: bytes) -> str:
    """Text of each page by its layout; empty where that fails."""
    import pdfplumber

    try:
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return "\n\n".join(page.extract_text() or "" for page in pdf.pages).strip()
    except Exception:
        return ""


def read_scan(content: bytes) -> str:
    """Recognised text of each page, drawn at twice its size; pages that fail are left out, a missing program raises."""
    import pypdfium2
    import pytesseract

    pytesseract.get_tesseract_version()
    pages = []
    document = pypdfium2.PdfDocument(content)
    try:
        for page in document:
            try:
                pages.append(pytesseract.image_to_string(page.render(scale=SCALE).to_pil()).strip())
            except pytesseract.TesseractNotFoundError:
                raise
            except Exception:
                pages.append("")
    finally:
        document.close()
    return "\n\n".join(p for p in pages if p).strip()


def installed() -> list[Callable[[bytes], str]]:
    """The text readers whose libraries are there, in the order they are tried."""
    return [read for read, module in ((read_partitions, "unstructured"), (read_text_layer, "pypdf"), (read_layout, "pdfplumber")) if _has(module)]


def ocr_reader() -> Callable[[bytes], str] | None:
    return read_scan if _has("pypdfium2", "pytesseract", "PIL") else None


def page_words(content: bytes) -> Iterator[dict]:
    """Words of a PDF's text layer by page, with their boxes in points."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for number, page in enumerate(pdf.pages):
            for w in page.extract_words(x_tolerance=3, y_tolerance=3, keep_blank_chars=False, use_text_flow=True) or []:
                yield {"page_number": number, "page_width": float(page.width), "page_height": float(page.height), **{k: w[k] for k in ("text", "x0", "top", "x1", "bottom")}}


def read_words(spark: SparkSession, path: str, reader: Callable[[bytes], Iterator[dict]] = page_words, pattern: str = "*.pdf") -> DataFrame:
    """source_file and the columns of ``WORDS``: the words that a reader finds in files; none of a file that it fails on."""
    columns = [c.split()[0] for c in WORDS.split(", ")]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["source_file"], batch["content"], strict=True):
                try:
                    words = [w for w in reader(content) if str(w.get("text", "")).strip()]
                except Exception:  # a file without a layout is read by its text alone
                    words = []
                if words:
                    yield pd.DataFrame(words)[columns].assign(source_file=name)[["source_file", *columns]]

    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    files = raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), "content")
    return files.mapInPandas(run, f"source_file string, {WORDS}")


def recognised_words(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Recognised boxes (text, conf, left, top, width, height in pixels) as words in points.

    The page's size in points and the picture's in pixels are ``page_width``, ``page_height``,
    ``image_width`` and ``image_height``.  Blank words and those of too little confidence go.
    """
    ratio = lambda page, image: F.col(page) / F.when(F.coalesce(F.col(image), F.lit(0)) == 0, 1).otherwise(F.col(image))
    sx, sy = ratio("page_width", "image_width"), ratio("page_height", "image_height")
    conf: Column = F.coalesce(F.col("conf").try_cast("int"), F.lit(0))
    kept = boxes.withColumn("text", strip(F.col("text"))).filter((F.col("text") != "") & (conf >= LEAST_CONFIDENCE))
    place = lambda at, size, scale: (F.col(at) * scale, (F.col(at) + F.col(size)) * scale)
    (x0, x1), (top, bottom) = place("left", "width", sx), place("top", "height", sy)
    return kept.select(*keys, "page_width", "page_height", "text", x0.alias("x0"), top.alias("top"), x1.alias("x1"), bottom.alias("bottom"))
