"""Template memory: similarity, matching, capping, promotion, and bad-value patterns."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from math import sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FLAGS, let, sections, strip

CAP = 20  # templates of each type, which bounds the store
AFTER = 1 << 40  # added to the order of templates that follow a store's own


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 4 digits; 0 for empty, unequal or zero ones."""
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.coalesce(F.when(fits, F.round(dot / (norm(a) * norm(b)), 4)), F.lit(0.0))


def java_pattern(pattern: Column) -> Column:
    """A stored pattern as Java takes it: named groups and the end of the text are written otherwise."""
    return F.concat(F.lit(FLAGS), F.replace(F.replace(pattern, F.lit("(?P<"), F.lit("(?<")), F.lit(r"\Z"), F.lit(r"\z")))


def anchor_share(anchors: Column, text: Column) -> Column:
    """Share of a template's anchors, a map of field to pattern, that the text matches, 4 digits; 0 without anchors."""
    hit = lambda p: (p != "") & F.regexp_like(text, java_pattern(p))
    share = F.size(F.filter(F.map_values(anchors), hit)) / F.size(anchors)
    return F.coalesce(F.when(F.size(anchors) > 0, F.round(share, 4)), F.lit(0.0))


def best_template(docs: DataFrame, templates: DataFrame, id_col: str = "doc") -> DataFrame:
    """Each document's most similar template of its type, the earliest among equals.

    ``docs(id, document_type, vector)`` and ``templates(document_type, ord, vector)``;
    the store holds at most ``CAP`` templates of a type, so each document meets few.
    Where the documents have a ``text`` and the templates ``anchors``, a similarity of 0
    is replaced by the share of the template's anchors found in a text that is not empty.
    """
    anchored = "text" in docs.columns and "anchors" in templates.columns
    t = templates.select("document_type", "ord", F.col("vector").alias("__tv"), *([F.col("anchors").alias("__ta")] if anchored else []))
    scored = docs.join(t, "document_type").withColumn("score", cosine(F.col("vector"), F.col("__tv")))
    if anchored:
        asked = (F.col("score") == 0) & (F.col("text") != "")
        scored = scored.withColumn("score", F.when(asked, anchor_share(F.col("__ta"), F.col("text"))).otherwise(F.col("score")))
    best = F.max(F.struct("score", (-F.col("ord")).alias("o"))).alias("b")
    return scored.groupBy(id_col, "document_type").agg(best).select(
        id_col, "document_type", F.col("b.score").alias("score"), (-F.col("b.o")).alias("ord")
    )


def similarity(a, b) -> float:
    """``cosine`` of two vectors in Python."""
    a, b = ([] if v is None else [float(x) for x in v] for v in (a, b))
    size = sqrt(sum(x * x for x in a)) * sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 4) if a and len(a) == len(b) and size > 0 else 0.0


def promote(source: DataFrame, target: DataFrame, key: str = "template_name") -> DataFrame:
    """Two stores by name: the target's order is kept, a source's template of a name takes the target's place, new ones follow.

    Stores may have ``ord``, their order; a template without a name is called ``template-`` and its place.
    """

    def named(df: DataFrame) -> DataFrame:
        if "ord" not in df.columns:
            return df
        return df.withColumn(key, F.coalesce(F.when(F.col(key) != "", F.col(key)), F.concat(F.lit("template-"), F.col("ord").cast("string"))))

    source, target = named(source), named(target)
    if "ord" not in source.columns or "ord" not in target.columns:
        return source.unionByName(target.join(source.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    places = target.select(F.col(key), F.col("ord").cast("long").alias("__old"))
    moved = source.join(places, key, "left").withColumn("ord", F.coalesce("__old", F.col("ord") + AFTER)).drop("__old")
    return moved.unionByName(target.join(source.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def bad_pattern(value: Column) -> Column:
    """Pattern of a rejected value: runs of its one character, or just that value, with white space around; null for a blank one."""
    v = strip(value)
    escape = lambda x: F.regexp_replace(x, r"([^A-Za-z0-9_])", r"\\$1")
    body = F.when(v.rlike(r"(?s)^(.)\1*\z"), F.concat(escape(F.substring(v, 1, 1)), F.lit("+"))).otherwise(escape(v))
    return F.when(v != "", F.concat(F.lit(r"^\s*"), body, F.lit(r"\s*$")))


#: Fields that no pattern clears.
NEVER_CLEARED = ("document_type", "source_file")


def valid_patterns(patterns: DataFrame) -> DataFrame:
    """The patterns that compile; others are ignored, as one that does not would stop the job."""

    @F.pandas_udf("boolean")
    def compiles(column: pd.Series) -> pd.Series:
        def one(p) -> bool:
            try:
                re.compile(p)
                return True
            except (re.error, TypeError):
                return False

        return column.map(one)

    return patterns.filter(compiles("pattern"))


def clear_bad_values(long_fields: DataFrame, patterns: DataFrame) -> DataFrame:
    """Nulls values of (document_type, field) that any of its patterns matches; adds ``cleared``.

    Values are searched without the white space around them; empty ones, and the fields of
    ``NEVER_CLEARED``, stay.  The patterns of a field come from reviews and are few.
    """
    lists = valid_patterns(patterns).groupBy("document_type", "field").agg(F.collect_set("pattern").alias("__p"))
    asked = ~F.col("field").isin(*NEVER_CLEARED) & (F.coalesce(F.col("value"), F.lit("")) != "")
    hit = asked & F.coalesce(F.exists("__p", lambda p: F.regexp_like(strip(F.col("value")), F.concat(F.lit(FLAGS), p))), F.lit(False))
    return (
        long_fields.join(lists, ["document_type", "field"], "left")
        .withColumn("cleared", hit).withColumn("value", F.when(~F.col("cleared"), F.col("value"))).drop("__p")
    )


#: Words that a text signature looks for.
SIGNATURE_WORDS = ("due date", "invoice", "supplier", "tax", "total", "vendor")


def anchor_values(anchors: Column, text: Column) -> Column:
    """Map of field to the text a template's pattern finds: its group ``value``, or all it matches; null without a match."""

    def value(_, pattern):
        grouped = F.contains(pattern, F.lit("(?P<value>"))
        found = strip(F.call_function("regexp_extract", text, java_pattern(pattern), F.when(grouped, 1).otherwise(0)))
        return F.when(found != "", found)

    return F.transform_values(anchors, value)


def text_signature(text: Column) -> Column:
    """Struct of the first eight lines with digits masked, and the signature words of the first twenty."""
    mask = lambda x: strip(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)\d", "#"), r"(?U)\s+", " "))

    def sign(ls):
        head = F.lower(F.array_join(F.slice(ls, 1, 20), " "))
        words = F.filter(F.array(*[F.lit(w) for w in SIGNATURE_WORDS]), lambda w: F.contains(head, w))
        return F.struct(F.transform(F.slice(ls, 1, 8), mask).alias("top_lines"), words.alias("keywords"))

    return let(sections(text), sign)


def signature_score(a, b) -> float:
    """0.7 of the matching-blocks ratio of the lines and 0.3 of the Jaccard similarity of the words; a null signature has neither."""
    (top, words), (other_top, other_words) = ((" | ".join(s["top_lines"]), set(s["keywords"])) if s else ("", set()) for s in (a, b))
    shared = len(words & other_words) / len(words | other_words) if words | other_words else 1.0
    return round(SequenceMatcher(None, top, other_top).ratio() * 0.7 + shared * 0.3, 4)


def score_signatures(pairs: DataFrame, left: str, right: str, out: str = "score") -> DataFrame:
    """Adds ``signature_score`` of two signature columns; each distinct pair of signatures is scored once.

    Matching blocks of two strings have no Catalyst form; the strings are eight lines long.
    """
    keyed = pairs.withColumn("__pair", F.sha2(F.to_json(F.struct(left, right), {"ignoreNullFields": "false"}), 256))
    distinct = keyed.groupBy("__pair").agg(F.first(left).alias("a"), F.first(right).alias("b"))

    @F.pandas_udf("double")
    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        rows = lambda d: [None if x["top_lines"] is None else x for x in d.to_dict("records")]
        return pd.Series([signature_score(x, y) for x, y in zip(rows(a), rows(b), strict=True)], dtype="float64")

    scored = distinct.select("__pair", score("a", "b").alias(out))
    return keyed.join(scored, "__pair").drop("__pair")
