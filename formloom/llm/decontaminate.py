"""Benchmark decontamination by winnowing (native).

Texts become words, words 64-bit hashes, and every k consecutive words a k-gram
hash.  Of each sliding window of w k-grams the smallest hash is kept, on either
side; with k + w - 1 equal to the shared length that counts, two texts that share
so many words keep the same k-gram of them, so a join of fingerprints misses none.
Each hit is extended word by word to the left and right; if the run that agrees is
long enough, its words are hit.  An item shorter than the window is one window and
is joined by the hash of all its words.

Defined results for odd input: null and empty texts have no words and no hits; a
null id is an id like any other; rows that agree in id and text share one result
each; an item id that repeats counts once; empty tables give empty results or
none hit; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import ascii_lower, let, total

#: The complement of a word character, for splitting lower-cased text.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _grams(h: Column, k: int) -> Column:
    """Struct of hash and position for each k-gram; the last k - 1 positions hold null hashes."""
    return F.transform(
        h,
        lambda x, i: F.struct(
            F.when(i <= F.size(h) - k, F.xxhash64(x, *[F.get(h, i + d) for d in range(1, k)])).alias("fp"),
            i.alias("pos"),
        ),
    )


def _winnowed(h: Column, k: int, w: int) -> Column:
    """The k-grams that are smallest in some window of ``w``, of the last position among equals.

    A position is kept if a window holds it as minimum: counting how far smaller
    hashes are on both sides decides that without building the windows.
    """

    def chosen(g: Column) -> Column:
        def is_kept(x: Column, i: Column) -> Column:
            fp = x["fp"]
            left = F.lit(0)
            for d in range(w - 1, 0, -1):  # nearest blocker to the left: smaller
                other = F.get(g, i - d)["fp"]
                left = F.when(other.isNotNull() & (other >= fp), left + 1).otherwise(F.lit(0))
            right = F.lit(0)
            for d in range(w - 1, 0, -1):  # to the right an equal hash blocks as well
                other = F.get(g, i + d)["fp"]
                right = F.when(other.isNotNull() & (other > fp), right + 1).otherwise(F.lit(0))
            return fp.isNotNull() & (left + right + 1 >= w)

        return F.filter(g, is_kept)

    return let(_grams(h, k), chosen)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    k: int = 8,
    min_pct: int = 5,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per document row: words, hit words, items found, and the verdict.

    A document is contaminated if it has hit words and they are at least ``min_pct``
    percent of its words.  The fingerprints of the benchmark are broadcast while their
    estimate stays under ``broadcast_bytes``, and shuffled beyond it.
    """
    w = window - k + 1
    reach = window - k
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    items = benchmark.select(benchmark[item_col].cast("string").alias("item_id"), benchmark[item_text_col].alias("text"))
    named = items.select(F.col("item_id").alias("name"), _hashes(_words(F.col("text"))).alias("ih")).filter(F.size("ih") > 0)
    # Items of one text are one item while they are searched for; their ids come back with the hits.
    named = named.select("name", "ih", F.xxhash64("ih", F.size("ih")).alias("item_id"))
    hashed = named.groupBy("item_id").agg(F.first("ih").alias("ih"))

    sizes = hashed.select(F.size("ih").alias("n")).agg(
        F.sum("n").alias("words"), F.collect_set(F.when(F.col("n") < window, F.col("n"))).alias("short")
    ).first()  # one row: a total and at most window - 1 lengths
    n_words, short = int(sizes["words"] or 0), sorted(sizes["short"] or [])
    small = n_words * 8 * (2 * reach + 6) <= broadcast_bytes
    hint = F.broadcast if small else (lambda x: x)

    long_items = hashed.filter(F.size("ih") >= window)
    side = [F.get("ih", F.col("ipos") + d).alias(f"i{d}") for d in _offsets(k, reach)]
    item_fps = (
        long_items.select("item_id", "ih", F.explode(_winnowed(F.col("ih"), k, w)).alias("g"))
        .select("item_id", "ih", F.col("g.fp").alias("fp"), F.col("g.pos").alias("ipos"))
        .select("item_id", "fp", *side)
    )
    tokens = rows.select("doc_id", F.xxhash64("text").alias("th"), let(_words(F.col("text")), _hashes).alias("h"))
    prints = tokens.select("doc_id", "th", "h", F.explode(_winnowed(F.col("h"), k, w)).alias("g")).select(
        "doc_id", "th", "h", F.col("g.fp").alias("fp"), F.col("g.pos").alias("pos")
    )
    if not small:  # the words around a hit travel instead of the whole text
        prints = prints.select(
            "doc_id", "th", "fp", "pos", *[F.get("h", F.col("pos") + d).alias(f"d{d}") for d in _offsets(k, reach)]
        )
    joined = prints.join(hint(item_fps), "fp")
    word = (lambda d: F.get("h", F.col("pos") + d)) if small else (lambda d: F.col(f"d{d}"))

    def run(step: int) -> Column:
        length = F.lit(0)
        for j in range(reach, 0, -1):
            d = -j if step < 0 else k - 1 + j
            length = F.when(word(d) == F.col(f"i{d}"), length + 1).otherwise(F.lit(0))
        return length

    hits = (
        joined.select("doc_id", "th", "item_id", "pos", run(-1).alias("a"), run(1).alias("b"))
        .filter(F.col("a") + F.col("b") + k >= window)
        .select(
            "doc_id",
            "th",
            "item_id",
            (F.col("pos") - F.col("a")).alias("start"),
            (F.col("pos") + k + F.col("b")).alias("stop"),
        )
    )
    if short:  # items of fewer words than a window: the words of each such length, by their hash and length, in one pass
        whole = hashed.filter(F.size("ih") < window).select("item_id", F.size("ih").alias("n"), F.xxhash64("ih").alias("fp"))
        found_runs = "array<struct<start:int,n:int,fp:bigint>>"

        def of_length(h: Column, n: int) -> Column:
            run = lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.xxhash64(F.slice(h, i + 1, n)).alias("fp"))
            return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), run)).otherwise(F.array().cast(found_runs))

        runs = lambda h: F.flatten(F.array(*[of_length(h, n) for n in short]))
        found = tokens.select("doc_id", "th", F.inline(let(F.col("h"), runs))).join(hint(whole), ["n", "fp"])
        hits = hits.unionByName(found.select("doc_id", "th", "item_id", "start", (F.col("start") + F.col("n")).alias("stop")))

    def covered(spans: Column) -> Column:
        """Positions in sorted spans, counted once: what a span adds beyond the furthest end before it."""
        added = F.aggregate(
            spans,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
            lambda acc, x: F.struct(
                (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["reach"]))).alias("n"),
                F.greatest(acc["reach"], x["stop"]).alias("reach"),
            ),
        )
        return added["n"]

    # Spans and items are first made distinct, so what meets for a document is bounded by its own length and the benchmark.
    per_doc = (
        hits.groupBy("doc_id", "th")
        .agg(
            F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"),
            F.collect_set("item_id").alias("keys"),
        )
        .select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), covered(F.col("spans")).alias("n_hit"), "keys")
    )
    names = named.select(F.col("item_id").alias("key"), "name").distinct()
    per_doc = (
        per_doc.select("hit_id", "hit_th", "n_hit", F.explode("keys").alias("key")).join(hint(names), "key")
        .groupBy("hit_id", "hit_th", "n_hit").agg(F.sort_array(F.collect_set("name")).alias("items"))
    )
    counted = rows.select(
        "doc_id", F.xxhash64("text").alias("th"), F.size(_words(F.col("text"))).cast("long").alias("n_words")
    )
    out = counted.join(
        per_doc, counted["doc_id"].eqNullSafe(per_doc["hit_id"]) & (counted["th"] == per_doc["hit_th"]), "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found_items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(found_items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (100 * n_hit >= min_pct * F.col("n_words"))).alias("contaminated"),
        found_items.alias("items"),
        "th",
    )


def _offsets(k: int, reach: int) -> list[int]:
    return [*range(-reach, 0), *range(k, k + reach)]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns; the verdict is joined on the id and a hash of the text."""
    bad = decontaminate(docs, benchmark, id_col, text_col).filter("contaminated")
    marked = bad.select(F.col("doc_id").alias("__bad_id"), F.col("th").alias("__bad_th")).distinct()
    th = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(marked, docs[id_col].eqNullSafe(F.col("__bad_id")) & (th == F.col("__bad_th")), "left_anti")
