"""Byte-level BPE encoding and decoding.

Tier one resolves a pre-token that is itself in the vocabulary by a minimal perfect
hash over all token byte strings.  Tier two, for the misses, merges the pre-token's
bytes: they form a doubly linked list, and a heap hands out the adjacent pair of
lowest rank, the leftmost among equals, until no pair is in the vocabulary.

Defined results for odd input: a null or empty text has no tokens; a null id is
passed through; repeated rows are encoded one by one; an empty table gives an empty
table; only the id and text columns are read.  A very long text or pre-token is
encoded whole, in n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

def load_ranks(path: str) -> list[bytes]:
    """Token byte strings by id from a file of ``base64 id`` lines; ids are 0..n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


class PerfectHash:
    """Minimal perfect hash of the vocabulary by hash and displace.

    Keys fall into buckets; a bucket stores a displacement that sends its keys to
    free slots, or, if it has one key, the slot itself as a negative number.  Each
    of the n slots holds one id, and the stored bytes confirm a hit.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        n = self.n = len(tokens)
        m = self.m = max(1, n // 3)
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(m)]
        for i, token in enumerate(tokens):
            h = xxhash.xxh3_64_intdigest(token)
            buckets[h % m].append((h, i))
        self.displacement = [0] * m
        self.slots = np.full(n, -1, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        order = sorted(range(m), key=lambda b: -len(buckets[b]))
        singles: list[int] = []
        for b in order:
            keys = buckets[b]
            if len(keys) == 1:
                singles.append(b)
            if len(keys) < 2:
                continue
            d = 1
            while True:
                spots = [xxhash.xxh3_64_intdigest(tokens[i], d) % n for _, i in keys]
                if len(set(spots)) == len(spots) and all(free[s] for s in spots):
                    break
                d += 1
            self.displacement[b] = d
            for s, (_, i) in zip(spots, keys, strict=True):
                free[s] = False
                self.slots[s] = i
        for b, s in zip(singles, np.flatnonzero(free).tolist(), strict=True):
            self.displacement[b] = -s - 1
            self.slots[s] = buckets[b][0][1]
        self.slots = self.slots.tolist()

    def get(self, token: bytes) -> int:
        """Id of a token, -1 if it is not in the vocabulary."""
        d = self.displacement[xxhash.xxh3_64_intdigest(token) % self.m]
        if d == 0:
            return -1
        i = self.slots[-d - 1 if d < 0 else xxhash.xxh3_64_intdigest(token, d) % self.n]
        return i if self.tokens[i] == token else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece that is not a token: lowest-rank merges over linked bytes."""
    get = ranks.get
    n = len(piece)
    end = list(range(1, n + 1))  # a live node i stands for piece[i:end[i]]
    before = list(range(-1, n - 1))
    live = [True] * n
    heap = []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or end[i] >= stop:
            continue
        j = end[i]
        if not live[j] or end[j] != stop:
            continue
        live[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0:
            r = get(piece[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _Memo(dict):
    """Encoded ids of pre-tokens seen by this worker, as bytes; emptied when full."""

    def __init__(self, table: PerfectHash, limit: int):
        self.table, self.limit = table, limit
        self.ranks = {token: i for i, token in enumerate(table.tokens)}  # of merged pairs

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        i = self.table.get(raw)
        out = array("I", [i] if i >= 0 else merge_bytes(raw, self.ranks)).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = out
        return out


class ByteBPE:
    """Encoder and decoder for one vocabulary; picklable, of the vocabulary's size."""

    def __init__(self, tokens: list[bytes], pattern: str, memo_limit: int = 500_000):
        self.table, self.pattern, self.memo_limit = PerfectHash(tokens), pattern, memo_limit
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self._ready is None:
            self._ready = regex.compile(self.pattern), _Memo(self.table, self.memo_limit)
        split, memo = self._ready
        return b"".join(map(memo.__getitem__, split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        tokens = self.table.tokens
        return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _coder(spark: SparkSession, ranks_path: str, pattern: str):
    # The vocabulary is read on the driver; what is sent to executors has its size, whatever the data.
    return spark.sparkContext.broadcast(ByteBPE(load_ranks(ranks_path), pattern))


def _string(column) -> Iterator[str]:
    for x in column:
        raw = x.as_py()
        yield "" if raw is None else raw.decode("utf-8", "replace")


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every text: doc_id, n_tokens, ids (array of int)."""
    coder = _coder(docs.sparkSession, ranks_path, pattern)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            encoded = [np.frombuffer(coder.value.encode(t), dtype="<u4").astype(np.int32) for t in _string(batch[1])]
            counts = [len(x) for x in encoded]
            flat = np.concatenate(encoded) if encoded else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(counts, pa.int64()), lists], ["doc_id", "n_tokens", "ids"])

    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text")).mapInArrow(run, schema)


def decode_ids(
    encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """Texts of token ids: doc_id, text (null for null ids)."""
    coder = _coder(encoded.sparkSession, ranks_path, pattern)

    def run(batches):
        for batch in batches:
            texts = []
            for x in batch[1]:
                ids = x.as_py()
                texts.append(None if ids is None else coder.value.decode(np.asarray(ids, "<u4").tobytes()).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(texts, pa.string())], ["doc_id", "text"])

    schema = T.StructType([T.StructField("doc_id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(encoded[id_col].alias("doc_id"), ids_col).mapInArrow(run, schema)


def round_trip_digests(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes and decodes every text and returns digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coder = _coder(docs.sparkSession, ranks_path, pattern)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in _string(batch[1]):
                ids = coder.value.encode(text)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(coder.value.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text")).mapInArrow(run, schema)
