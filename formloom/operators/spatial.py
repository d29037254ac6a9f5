"""Page geometry: zone density and rows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


def zone_density(words: DataFrame, rows: int = 8, cols: int = 10) -> DataFrame:
    """Text length by cell of the first page's grid over that of the fullest cell: doc, zone_density (array).

    A word counts in the cell of its upper left corner, taken as a share of the page with
    four digits; the first page is the first that has words.
    """
    share = lambda v, size: F.coalesce(F.when(F.col(size) != 0, F.round(F.col(v) / F.col(size), 4)), F.lit(0.0))
    bound = lambda v, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v * n))).cast("int")
    cell = bound(share("top", "page_height"), rows) * cols + bound(share("x0", "page_width"), cols)
    sums = words.groupBy("doc", "page_number", cell.alias("cell")).agg(F.sum(F.length("text")).alias("n"))
    pages = sums.groupBy("doc", "page_number").agg(F.max("n").alias("top"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"))
    first = pages.groupBy("doc").agg(F.min_by(F.struct("top", "m"), "page_number").alias("p")).select("doc", "p.top", "p.m")
    full = F.when(F.col("top") > 0, F.col("top")).otherwise(1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: F.round(F.coalesce(F.element_at("m", i), F.lit(0)) / full, 4))
    return first.select("doc", grid.alias("zone_density"))


def cluster_rows(words: Column, tolerance: float = 3.0) -> Column:
    """Rows of words (array of arrays): a word joins the newest row whose first word's middle is near.

    Words come by their middle, so rows follow one another in that order: the fold keeps
    only where each starts.
    """
    middle = lambda w: (w["top"] + w["bottom"]) / 2
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(middle(w).alias("y"), w["x0"].alias("x"), w.alias("w"))))
    empty = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("starts"))

    def place(acc, s):
        near = F.coalesce(F.abs(acc["anchor"] - s["y"]) <= tolerance, F.lit(False))
        anchor = F.when(near, acc["anchor"]).otherwise(s["y"].cast("double"))
        starts = F.when(near, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["n"])))
        return F.struct((acc["n"] + 1).alias("n"), anchor.alias("anchor"), starts.alias("starts"))

    def rows_of(sorted_words):
        cut = lambda starts: F.transform(
            starts, lambda at, i: F.transform(F.slice(sorted_words, at + 1, F.coalesce(F.get(starts, i + 1), F.size(sorted_words)) - at), lambda s: s["w"])
        )
        return let(F.aggregate(sorted_words, empty, place, lambda acc: acc["starts"]), cut)

    return let(ordered, rows_of)
