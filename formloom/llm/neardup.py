"""MinHash near-duplicates by an inverted join of signature coordinates.

Texts with equal shingle sets form a class.  Each class posts itself under every
(coordinate, value) pair of its MinHash signature.  Two classes count as candidates
if they collide in at least ``matches`` of the ``coordinates`` lists.  That needs
no pass over all pairs:

* prefix: a class orders its lists from rare to frequent.  Two classes with that
  many common lists share one among the first ``lists - matches + 1`` of either, so
  only these are merged, and the most frequent ones are not.
* skip: lists of one class and classes with fewer than ``matches`` shared lists are
  dropped first; inside a list every class is tried against the list's most central
  class, and what these confirmed links already join is skipped afterwards.
* the rest of a list, classes in different components, is joined in full, with the
  count of collisions as the join's condition, each pair in its first common list
  only; so hot lists lose no link.  There a pair must also pass a finer estimate, the
  agreement of 1,024 one-bit coordinates, as large groups of almost similar texts
  would otherwise give many pairs to confirm.

Candidates are confirmed on the full shingle sets of their texts.  With 64
coordinates and 32 matches a pair at similarity 0.75 is missed with a probability of
about 4 in a million, one at 0.8 with less than 1 in 10 million; the finer estimate
has 4.7 standard deviations to spare at 0.75.

Defined results for odd input: null, empty and blank texts have no shingles, are
linked with nothing and stay; a null id takes no part in linking, its component is
that of its class or null; rows of one id are one node, linked by any of their
texts; repeated rows each get a result; an empty table gives an empty table; only
the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import drop_written, written
from .shingles import mix, shingle_set, word_hashes


_BITS = 1024


def _arrow_bytes(column) -> list[bytes]:
    return [x.as_py() or b"" for x in column]


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes, null without shingles), sig (array of int)."""
    seeds = np.random.default_rng(97).integers(1, 1 << 63, (2, coordinates), dtype=np.uint64)
    scale, shift = seeds[0] | np.uint64(1), seeds[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(w, k) for w in word_hashes(_arrow_bytes(part[1]))]
                n = np.array([len(x) for x in sets])
                sig = np.zeros((len(sets), coordinates), dtype=np.int32)
                keys: list[bytes | None] = []
                for i, x in enumerate(sets):
                    if not len(x):
                        keys.append(None)
                        continue
                    a, b = mix(x ^ np.uint64(0x5851F42D4C957F2D)), mix(x + np.uint64(0x14057B7EF767814F))
                    keys.append(int(a.sum(dtype=np.uint64)).to_bytes(8, "big") + int(b.sum(dtype=np.uint64)).to_bytes(8, "big"))
                full = [i for i in range(len(sets)) if n[i]]
                if full:
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    for c in range(coordinates):
                        low = np.minimum.reduceat(mix(flat * scale[c] + shift[c]), starts)
                        sig[full, c] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
                offsets = np.arange(0, (len(sets) + 1) * coordinates, coordinates, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part[0], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.ravel()))],
                    ["doc_id", "n_shingles", "set_key", "sig"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set_key", T.BinaryType()),
            T.StructField("sig", T.ArrayType(T.IntegerType())),
        ]
    )
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text")).mapInArrow(run, schema)


SALTS = 32


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` of ``pairs(rep, hub)`` whose full shingle sets are similar enough.

    A pair travels with the set of ``rep``; that of a hub, which many pairs may share, goes
    once to each of its salts, over which its pairs are dealt.
    """
    salted = written(pairs.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")), "pairs")  # read twice
    mine = sets.select(F.col("doc_id").alias("rep"), F.col("set").alias("a"))
    other = salted.select(F.col("hub").alias("h"), F.col("salt").alias("s")).distinct().join(
        sets.select(F.col("doc_id").alias("h"), F.col("set").alias("b")), "h"
    )
    joined = salted.join(mine, "rep").join(other, (F.col("hub") == F.col("h")) & (F.col("salt") == F.col("s")))
    common = F.size(F.array_intersect("a", "b"))
    similar = joined.filter(100 * common >= percent * (F.size("a") + F.size("b") - common))
    return similar.select(F.greatest("rep", "hub").alias("u"), F.least("rep", "hub").alias("v")).distinct()


def _with_sets(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, set (hashes of all shingles), bits (1,024 one-bit MinHash coordinates, as 16 longs)."""
    seeds = np.random.default_rng(98).integers(1, 1 << 63, (2, _BITS), dtype=np.uint64)
    scale, shift = (seeds[0] | np.uint64(1))[:, None], seeds[1][:, None]
    group = 64

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, sets = [], []
                for words in word_hashes(_arrow_bytes(part[1])):
                    x = shingle_set(words, k)
                    sets.append(x.view(np.int64))
                    bits = np.zeros(_BITS, dtype=np.uint8)
                    for g in range(0, _BITS, group):
                        low = np.full(group, np.iinfo(np.uint64).max, dtype=np.uint64)
                        for b in range(0, len(x), 4096):  # bounded memory for long texts
                            h = x[None, b : b + 4096] * scale[g : g + group] + shift[g : g + group]
                            h ^= h >> np.uint64(32)
                            h *= np.uint64(0xBF58476D1CE4E5B9)
                            np.minimum(low, h.min(axis=1), out=low)
                        bits[g : g + group] = (low >> np.uint64(7)) & np.uint64(1)
                    rows.append(np.packbits(bits).view(">i8").astype(np.int64))
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                n = _BITS // 64
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(rows) + 1) * n, n), pa.int32()), pa.array(flat))
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                whole = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets) if sets else flat))
                yield pa.RecordBatch.from_arrays([part[0], whole, lists], ["doc_id", "set", "bits"])

    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [texts.schema["doc_id"], T.StructField("set", longs), T.StructField("bits", longs)]
    )
    return texts.select("doc_id", "text").mapInArrow(run, schema)


def _agree(a: str, b: str):
    """How many one-bit coordinates agree."""
    unlike = F.lit(0)
    for i in range(_BITS // 64):
        unlike = unlike + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return F.lit(_BITS) - unlike


def _least_agreement(percent: int) -> int:
    """Agreement that a pair of ``percent`` similarity misses with about one in a million."""
    p = (1 + percent / 100) / 2
    return int(_BITS * p - 4.7 * (_BITS * p * (1 - p)) ** 0.5)


def _matches(a: str, b: str):
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 75,
    coordinates: int = 64,
    matches: int = 32,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    sigs = written(signatures(docs, id_col, text_col, k, coordinates), "sigs")
    classes = written(
        sigs.filter("set_key is not null and doc_id is not null")
        .groupBy("set_key", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")),
        "classes",
    )
    posts = classes.select("rep", F.posexplode("sig").alias("i", "value")).select(
        "rep", F.xxhash64("i", "value").alias("key")
    )
    lists = posts.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    mine = posts.join(lists, "key").groupBy("rep").agg(F.collect_list(F.struct("size", "key")).alias("lists"))  # at most one per coordinate
    active = mine.filter(F.size("lists") >= matches)
    prefixes = written(
        active.select(
            "rep",
            F.slice(F.sort_array("lists"), F.lit(1), F.size("lists") - (matches - 1)).alias("prefix"),
            F.aggregate("lists", F.lit(0).cast("long"), lambda acc, x: acc + x["size"]).alias("central"),
        ),
        "prefixes",
    )
    sig = classes.select("rep", "sig")
    members = written(
        prefixes.select("rep", "central", F.explode("prefix").alias("p"))
        .select("rep", "central", F.col("p.key").alias("key"))
        .join(sig, "rep"),
        "members",
    )
    sets = written(
        _with_sets(docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text")).join(
            prefixes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"
        ), k),
        "sets",
    )
    hubs = members.groupBy("key").agg(
        F.max_by(F.struct("rep", "sig"), F.struct("central", "rep")).alias("hub"), F.count("*").alias("n")
    ).filter("n > 1")
    tried = (
        members.join(hubs, "key")
        .filter(F.col("rep") != F.col("hub.rep"))
        .select("rep", "sig", F.col("hub.rep").alias("hub"), F.col("hub.sig").alias("hub_sig"))
        .filter(_matches("sig", "hub_sig") >= matches)
        .select("rep", "hub")
        .distinct()
    )
    first = written(_confirmed(tried, sets, percent), "links")
    stars = written(components(first), "stars")

    # The rest: classes of one list that are in different components by now.
    placed = written(
        prefixes.select("rep", "prefix")
        .join(stars.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("rep", "prefix.key", F.coalesce("component", "rep").alias("component"))
        .withColumnRenamed("key", "keys")
        .withColumn("key", F.explode("keys")),
        "placed",
    )
    split = (
        placed.groupBy("key", "component").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
        .filter("parts > 1").select("key", F.col("main.component").alias("main"))
    )
    bits = sets.groupBy(F.col("doc_id").alias("rep")).agg(F.first("bits").alias("bits"))
    open_lists = placed.join(split, "key").join(sig, "rep").join(bits, "rep")
    others = open_lists.filter("component <> main").select(
        F.col("key").alias("k2"), F.col("rep").alias("r2"), F.col("sig").alias("s2"), F.col("component").alias("c2"), F.col("keys").alias("ks2"), F.col("bits").alias("b2")
    )
    rest = (
        open_lists.join(
            others,
            (F.col("key") == F.col("k2"))
            & (F.col("component") != F.col("c2"))
            & ((F.col("component") == F.col("main")) | (F.col("rep") < F.col("r2")))
            & (_agree("bits", "b2") >= _least_agreement(percent))
            & (F.get(F.array_intersect("keys", "ks2"), F.lit(0)) == F.col("key"))
            & (_matches("sig", "s2") >= matches),
        )
        .select(F.greatest("rep", "r2").alias("u"), F.least("rep", "r2").alias("v"))
        .distinct()
    )
    rest = rest.join(first, ["u", "v"], "left_anti").select(F.col("u").alias("rep"), F.col("v").alias("hub"))
    second = written(_confirmed(rest, sets, percent), "links")
    final = written(components(first.union(second)), "final")
    drop_written(prefixes, members, sets, first, stars, placed, second)

    class_of = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("set_key").alias("ck"), F.col("n_shingles").alias("cn"), F.coalesce("component", "rep").alias("class_component")
    )
    out = sigs.join(class_of, (F.col("set_key") == F.col("ck")) & (F.col("n_shingles") == F.col("cn")), "left")
    component = F.coalesce("class_component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one of the least id.

    An id that is not the least of its group goes with all of its texts, as they are one node.
    Rows alike in id and text are one document, of which one row stays; so are such rows without an id.
    """
    gone = near_duplicates(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    kept = docs.join(gone, docs[id_col] == F.col("__gone_id"), "left_anti")
    return kept.dropDuplicates([id_col, text_col])
