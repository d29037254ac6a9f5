"""Suffix-array dedup: bytes covered by a long string that also starts earlier.

Only strings of at least ``least`` bytes matter, so the corpus need not meet in one
suffix array.  Each window of that many bytes is filed under the smallest hash of the
grams in it: equal windows have equal ones.  Neighbouring windows filed under one gram
form a segment, of at most as many windows as a gram can lie in, so periodic text gives
segments of about twice its bytes.  A segment whose gram no other has can only repeat
itself, which takes the gram twice in it.  Equal segments, equal in the hash of their gram
and a hash of all their bytes, are summed up first: all but the earliest are repeats
throughout.  The earliest ones of each gram are compared, with each other and in
themselves, by interval expansion on a Burrows-Wheeler transform (``bwt``), many grams to
a block.  A gram with more unlike segments than ``bucket`` would make a
block of any size, so its windows are hashed and grouped instead, which gives the same.

A text is known by its id and a hash.  Building the frame runs jobs: each step is a table
in the shared folder, and a step's table is deleted after its last use.

Defined results for odd input: a null or empty text has no bytes; a null id comes
after all others; rows alike in id and text are one text and each get its result; of
unlike texts under one id the one with the smaller hash counts as earlier; an empty
table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeated_windows
from .shared import drop_written, written
from .shingles import mix

GRAM = 32
BLOCK = 1 << 16  # bytes hashed at once
COMPARED = 1 << 19  # bytes to a transform
_rng = np.random.default_rng(20240608)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_R = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        x = np.full(max(n, BLOCK + 256), base, dtype=np.uint64)
        x[0] = 1
        _tables[name] = np.cumprod(x, dtype=np.uint64)
    return _tables[name][:n]


def segments(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, segment hash, start, stop, kind) of the segments of some texts.

    The kind is 0 for a segment that its own text has before, byte for byte, 2 for another
    one that may hold a window twice, and else 1.
    """
    parts: list[list[np.ndarray]] = []
    block: list[tuple[int, int, bytes]] = []
    size = 0
    for i, raw in enumerate(texts):
        for at in range(0, len(raw) - least + 1, BLOCK):
            piece = raw[at : at + BLOCK + least - 1]
            if block and size + len(piece) > BLOCK:
                parts.append(_block(block, least))
                block, size = [], 0
            block.append((i, at, piece))
            size += len(piece)
    if block:
        parts.append(_block(block, least))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, np.int8),)
    owner, fp, sh, start, stop, inner = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, sh, owner))
    again = (owner[order][1:] == owner[order][:-1]) & (sh[order][1:] == sh[order][:-1])
    kind = 1 + inner.astype(np.int8)
    kind[order[1:][again]] = 0
    return owner, fp, sh, start, stop, kind


def _block(pieces: list[tuple[int, int, bytes]], least: int) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(x for _, _, x in pieces), dtype=np.uint8)
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * _power(_R, "up", n), out=sums[1:])
    back = _power(pow(_R, -1, 1 << 64), "down", n)
    grams = low = mix((sums[GRAM:] - sums[: n - GRAM + 1]) * back[: n - GRAM + 1])
    width, reach = 1, least - GRAM + 1
    while width < reach:  # minima of windows by doubling
        step = min(width, reach - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    lengths = np.array([len(x) for _, _, x in pieces])
    begin = np.cumsum(lengths) - lengths
    windows = lengths - least + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[piece]  # windows inside a piece
    gram = low[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (piece[1:] != piece[:-1])
    runs = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))
    heads = inside % reach == 0
    cut = np.flatnonzero(heads)
    # Where a segment holds a window twice, one of its windows starts with the gram, and the next one has that gram again.
    twice = (grams[at] == gram) & ~np.append(heads[1:], True)
    start = at[cut]
    stop = at[np.append(cut[1:], len(at)) - 1] + least
    whole = mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64) * np.uint64(_R))
    piece = piece[cut]
    shift = np.array([x for _, x, _ in pieces])[piece] - begin[piece]
    owner = np.array([i for i, _, _ in pieces])[piece]
    inner = np.logical_or.reduceat(twice, cut)
    return [owner, gram[cut].view(np.int64), whole.view(np.int64), start + shift, stop + shift, inner]


def _all_segments(texts: DataFrame, least: int) -> DataFrame:
    """doc, th, fp, sh, start, stop, kind of ``texts(doc, th, text)``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, fp, sh, start, stop, kind = segments([x.as_py() or b"" for x in part[2]], least)
                place = pa.array(owner)
                columns = [pa.array(fp), pa.array(sh), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(kind)]
                yield pa.RecordBatch.from_arrays(
                    [part[0].take(place), part[1].take(place), *columns], ["doc", "th", "fp", "sh", "start", "stop", "kind"]
                )

    return texts.select("doc", "th", "text").mapInArrow(run, "doc long, th long, fp long, sh long, start int, stop int, kind byte")


def _compared(rows: DataFrame, least: int) -> DataFrame:
    """Repeats (doc, th, start, stop) among unlike segments (fp, doc, th, start, bytes), partitioned and sorted by gram."""

    def spans(block):
        piece, offset, group = repeated_windows([r[4] for r in block], least)
        doc, th = (np.array([r[i] for r in block], dtype=np.int64)[piece] for i in (1, 2))
        at = np.array([r[3] for r in block], dtype=np.int64)[piece] + offset
        order = np.lexsort((at, th, doc, group))
        group, doc, th, at = group[order], doc[order], th[order], at[order]
        head = np.searchsorted(group, group)  # each group's earliest, of which repeated rows may give more than one
        later = (doc != doc[head]) | (th != th[head]) | (at != at[head])
        doc, th, at = doc[later], th[later], at[later]
        order = np.lexsort((at, th, doc))
        doc, th, at = doc[order], th[order], at[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (at[1:] > at[:-1] + least)
        new = np.flatnonzero(new)
        last = np.append(new[1:], len(doc))[: len(new)] - 1
        return np.stack((doc[new], th[new], at[new], at[last] + least), axis=1)

    def run(batches):
        block, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch[i].to_pylist() for i in range(5)), strict=True):
                if size > COMPARED and row[0] != last:
                    yield from emit(spans(block))
                    block, size = [], 0
                block.append(row)
                size += len(row[4])
                last = row[0]
        if block:
            yield from emit(spans(block))

    def emit(found):
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i].copy()) for i in range(4)], ["doc", "th", "start", "stop"])

    return rows.mapInArrow(run, "doc long, th long, start long, stop long")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 100, bucket: int = 20_000
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: one row per input row."""
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).withColumns(
        {"doc": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "th": F.xxhash64("text")}
    )
    place = ["doc", "th", "start"]
    cut = written(_all_segments(rows.filter(F.octet_length("text") >= least), least), "cut")
    shared = cut.groupBy("fp").agg(F.count("*").alias("n"), F.max("kind").alias("kind")).filter("n > 1 or kind = 2").select("fp")
    found = written(cut.join(shared, "fp", "left_semi"), "segments")
    drop_written(cut)
    groups = found.filter("kind > 0").groupBy("fp", "sh").agg(
        F.min(F.struct(*place, "stop")).alias("e"), F.count("*").alias("n"), F.max("kind").alias("kind")
    )
    groups = written(groups.select("fp", "sh", "e.*", "n", "kind"), "groups")
    # All but the earliest of equal segments are repeats throughout.
    earliest = groups.filter("n > 1").select("fp", "sh", *[F.col(c).alias(f"e_{c}") for c in place])
    unlike_place = (F.col("doc") != F.col("e_doc")) | (F.col("th") != F.col("e_th")) | (F.col("start") != F.col("e_start"))
    span = ["doc", "th", *[F.col(c).cast("long").alias(c) for c in ("start", "stop")]]
    elsewhere = found.filter("kind > 0").join(earliest, ["fp", "sh"]).filter(unlike_place).select(*span)
    again = written(elsewhere.union(found.filter("kind = 0").select(*span)), "again")
    drop_written(found)
    many = groups.groupBy("fp").agg(F.count("*").alias("unlike"), F.max("kind").alias("kind")).filter("unlike > 1 or kind = 2").drop("kind")
    pieces = groups.drop("n", "kind").join(many, "fp").join(rows.select("doc", "th", "text"), ["doc", "th"]).select(
        "fp", *place, F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")).alias("bytes"), "unlike"
    )
    pieces = written(pieces, "pieces")
    drop_written(groups)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = pieces.filter(F.col("unlike") <= bucket).select("fp", *place, "bytes")
    inside = written(_compared(common.repartition(parts, "fp").sortWithinPartitions("fp"), least), "inside")
    windows = (
        pieces.filter(F.col("unlike") > bucket)
        .select("doc", "th", "start", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - least)).alias("o"))
        .select("doc", "th", (F.col("start") + F.col("o")).cast("long").alias("at"), F.sha2(F.substring("bytes", F.col("o") + 1, F.lit(least)), 256).alias("w"))
    )
    heads = windows.groupBy("w").agg(F.min(F.struct("doc", "th", "at")).alias("e"), F.count("*").alias("n")).filter("n > 1").select("w", "e")
    hot = (
        windows.join(heads, "w").filter(F.struct("doc", "th", "at") != F.col("e"))
        .select("doc", "th", F.col("at").alias("start"), (F.col("at") + least).alias("stop"))
    )
    hot = written(hot, "hot")
    drop_written(pieces)
    spans = (
        again.unionByName(inside).unionByName(hot)
        .groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))  # bounded by a text's length
    )
    marked = rows.join(spans, ["doc", "th"], "left")

    def run(batches):
        for batch in batches:
            counts, removed, n_spans, shas, kept = [], [], [], [], []
            for raw, spans_of in zip(batch[1], batch[2], strict=True):
                raw, spans_of = raw.as_py() or b"", spans_of.as_py() or []
                pieces_of, last, gone, runs = [], 0, 0, 0
                reach = -1
                for s in spans_of:
                    a, b = s["start"], s["stop"]
                    if a > reach:
                        pieces_of.append(raw[last:a])
                        runs += 1
                        gone += b - a
                        last = reach = b
                    elif b > reach:
                        gone += b - reach
                        last = reach = b
                pieces_of.append(raw[last:])
                rest = b"".join(pieces_of)
                counts.append(len(raw))
                removed.append(gone)
                n_spans.append(runs)
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            longs = [pa.array(x, pa.int64()) for x in (counts, removed, n_spans)]
            yield pa.RecordBatch.from_arrays(
                [batch[0], *longs, pa.array(shas, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return marked.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )

