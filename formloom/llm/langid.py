"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of a page's text under hashed
character trigram models, the language its markup declares, the suffix of its
address, and a prior of its host.  The trigram counts are summed over all labelled
documents.  The other tables come from grouped counts of the pages' own text
verdicts: P(declared | language), P(suffix | language), and host priors that shrink
to the parent domain's, and that to the whole corpus's, by ``strength`` pseudo-counts.
The log-likelihood of a text is tempered, as its trigrams are not independent.

Defined results for odd input: null or empty html leaves the other evidence; a null
URL has an empty host and suffix; without any evidence the corpus's prior decides; a
null id is passed through; repeated rows are judged one by one; documents without a
known language are left out of training; empty tables give empty results or uniform
models; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .native import LOWER, UPPER

LANGUAGES = ("de", "en", "es", "fr")
BINS = 1 << 15
BLOCK = 1 << 19  # characters handled at once


def _bins(text: str) -> np.ndarray:
    """Bins of the trigrams of a text's lower-cased letters, with one space for all else."""
    raw = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    letters = ((raw >= 97) & (raw <= 122)) | (raw >= 0xAA)
    c = np.where(letters, raw, np.uint64(32))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))] if len(c) else c
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64)


def _pieces(text: str):
    for at in range(0, len(text), BLOCK):
        yield text[at : at + BLOCK + 2]


def trigram_counts(docs: DataFrame, languages=LANGUAGES, lang_col: str = "lang", text_col: str = "text") -> np.ndarray:
    """Counts [language, bin] over all labelled documents; at most that many rows reach the driver."""
    place = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        sums = np.zeros((len(languages), BINS), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                raw = text.as_py()
                if raw is not None:
                    for piece in _pieces(raw.decode("utf-8", "replace")):
                        sums[place[lang]] += np.bincount(_bins(piece), minlength=BINS)
        flat = sums.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], ["slot", "n"])

    rows = (
        docs.select(docs[lang_col].alias("lang"), docs[text_col].cast("binary").alias("text"))
        .filter(F.col("lang").isin(*languages))
        .mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    )
    out = np.zeros(len(languages) * BINS)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(len(languages), BINS)


def visible_text(html: Column) -> Column:
    """Text of a page without comments, scripts, styles and tags."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[a-zA-Z]+;|&#\d+;", " ")


def _argmax(scores: Column, languages) -> Column:
    best = F.array_max(scores)
    return F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(scores, best).cast("int"))


def identify_language(
    pages: DataFrame,
    labelled: DataFrame,
    languages=LANGUAGES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    strength: float = 10.0,
    temper: float = 0.1,
) -> DataFrame:
    """page_id, host, declared, suffix, text_lang, lang, confidence: one row per input row."""
    counts = trigram_counts(labelled, languages)
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)).astype(np.float32)
    model = pages.sparkSession.sparkContext.broadcast(logs)  # a fixed size: languages times BINS

    def run(batches):
        for batch in batches:
            out = []
            for text in batch[4]:
                raw = text.as_py() or b""
                score = np.zeros(len(languages))
                for piece in _pieces(raw.decode("utf-8", "replace")):
                    score += model.value[:, _bins(piece)].sum(axis=1)
                out.append((score - score.max()).tolist())
            yield pa.RecordBatch.from_arrays(
                [*(batch[i] for i in range(4)), pa.array(out, pa.list_(pa.float64()))],
                ["page_id", "host", "declared", "suffix", "text_log"],
            )

    url = F.coalesce(pages[url_col], F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#:]*)", 1), UPPER, LOWER)
    declared = F.lower(F.regexp_extract(F.coalesce(pages[html_col], F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2})\b", 1))
    rows = pages.select(
        pages[id_col].alias("page_id"), host.alias("host"), declared.alias("declared"),
        F.element_at(F.split(host, r"\."), -1).alias("suffix"),
        visible_text(pages[html_col]).cast("binary").alias("text"),
    )
    schema = T.StructType(
        [*[rows.schema[c] for c in ("page_id", "host", "declared", "suffix")], T.StructField("text_log", T.ArrayType(T.DoubleType()))]
    )
    from .shared import written

    scored = written(rows.mapInArrow(run, schema), "scored")
    scored = scored.withColumn("text_lang", _argmax(F.col("text_log"), languages)).withColumn(
        "domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    )

    sums = [F.sum(F.when(F.col("text_lang") == x, 1.0).otherwise(0.0)).alias(x) for x in languages]
    vector = F.array(*[F.col(x) for x in languages])

    def table(key: str, name: str) -> DataFrame:
        return scored.groupBy(key).agg(*sums).select(key, vector.alias(name))

    whole = scored.agg(*sums).select(vector.alias("v")).first()["v"]
    totals = [float(x or 0) for x in whole]
    corpus = [(t + 1) / (sum(totals) + len(languages)) for t in totals]

    def shrink(n: Column, prior: Column) -> Column:
        """Counts smoothed towards a prior."""
        size = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, prior, lambda x, p: (x + p * strength) / (size + strength))

    def evidence(n: Column) -> Column:
        """log P(value | language), up to a constant."""
        rates = F.zip_with(n, F.array(*[F.lit(t) for t in totals]), lambda x, t: F.log((x + 0.5) / (t + 1.0)))
        return F.coalesce(rates, F.array(*[F.lit(0.0)] * len(languages)))

    joined = (
        scored.join(table("host", "host_n"), "host", "left")
        .join(table("domain", "domain_n"), "domain", "left")
        .join(table("declared", "declared_n"), "declared", "left")
        .join(table("suffix", "suffix_n"), "suffix", "left")
    )
    domain_prior = shrink(F.col("domain_n"), F.array(*[F.lit(x) for x in corpus]))
    parts = F.arrays_zip(
        F.col("text_log").alias("t"),
        evidence(F.col("declared_n")).alias("d"),
        evidence(F.col("suffix_n")).alias("s"),
        shrink(F.col("host_n"), domain_prior).alias("h"),
    )
    posterior = F.transform(
        parts,
        lambda x: x["t"] * temper
        + F.when(F.col("declared") != "", x["d"]).otherwise(0.0)
        + F.when(F.col("suffix") != "", x["s"]).otherwise(0.0)
        + F.log(x["h"]),
    )
    final = joined.select("page_id", "host", "declared", "suffix", "text_lang", posterior.alias("post"))
    best = F.array_max("post")
    mass = F.aggregate(F.transform("post", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    return final.select(
        "page_id", "host", "declared", "suffix", "text_lang",
        _argmax(F.col("post"), languages).alias("lang"), F.round(1 / mass, 6).alias("confidence"),
    )
