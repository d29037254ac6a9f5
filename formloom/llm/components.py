"""Connected components of an edge table by alternating stars, without a driver or a hot task.

Each round hangs every node's larger neighbours on its smallest one, then every
node's smaller neighbours.  Minima are combined before the shuffle, no list of
neighbours is ever gathered, and a hot node is dealt over many tasks.  Rounds are
logarithmic in the longest path.

Defined results for odd input: edges with a null end and loops are left out; repeated
edges and cycles change nothing; no edges give no nodes.  Jobs run when it is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written


SALTS = 32


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs(u, v)`` with ``m``, the least ``v`` of each ``u``.

    A node with a third of all edges is dealt over ``SALTS`` tasks: minima are taken by
    node and salt, then by node, and come back to node and salt.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))  # at most SALTS
    spread = least.select(F.col("u").alias("k"), F.explode("salts").alias("s"), "m")
    return salted.join(spread, (F.col("u") == F.col("k")) & (F.col("salt") == F.col("s"))).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    hung = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; a component is its least node."""
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        star = _small_star(_large_star(edges)).filter("u <> v").distinct()
        star = written(star, "edges")
        same = _digest(star) == _digest(edges)
        drop_written(edges)
        edges = star
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("c")).select(F.col("u").alias("node"), F.col("c").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
        ).first()
    )
