"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a token itself costs one probe
and one comparison. Tier two merges the other pre-tokens with a heap of pairs over doubly linked bytes, in
O(n log n) for a pre-token of n bytes, so that long runs without a break stay cheap.

Null texts encode as empty ones. Ids are packed as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fxlake.llm.common import bounded_batches, read_table, text_or_empty

#: Vocabularies are broadcast; a file beyond this size is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens that one worker remembers before it starts afresh, and the longest that it remembers.
MEMO_ENTRIES, MEMO_CHARS = 1 << 20, 48


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a tiktoken rank file. The file's size is checked before it is read."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file above {MAX_VOCABULARY_BYTES} bytes: {path}")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


@dataclass
class PerfectHash:
    """A minimal perfect hash: n keys to n slots by a displacement for each bucket of about two keys.

    A bucket's displacement d sends its keys to the high half of h1 + d * h2, mod n; a bucket with one key holds ~slot.
    The slot's key is compared, so a string that is no key is never taken for one.
    """

    displacements: list[int]
    keys: list[bytes]
    values: list[int]

    @staticmethod
    def _parts(key: bytes, buckets: int) -> tuple[int, int, int]:
        x = xxhash.xxh3_128_intdigest(key)
        return (x >> 96) % buckets, x & 0xFFFFFFFFFFFFFFFF, x >> 64 | 1

    @staticmethod
    def _slot(h1: int, h2: int, d: int, n: int) -> int:
        return (h1 + d * h2 & 0xFFFFFFFFFFFFFFFF) // 0x100000000 % n

    @classmethod
    def build(cls, table: dict[bytes, int]) -> PerfectHash:
        n, buckets = len(table), max(1, len(table) // 2)
        groups: list[list[tuple[int, int, bytes]]] = [[] for _ in range(buckets)]
        for key in table:
            bucket, h1, h2 = cls._parts(key, buckets)
            groups[bucket].append((h1, h2, key))
        displacements, slots = [0] * buckets, [None] * n
        order = sorted(range(buckets), key=lambda b: -len(groups[b]))
        for bucket in (b for b in order if len(groups[b]) > 1):
            d = 0
            while True:
                places = {cls._slot(h1, h2, d, n) for h1, h2, _ in groups[bucket]}
                if len(places) == len(groups[bucket]) and all(slots[p] is None for p in places):
                    break
                d += 1
                if d > 50 * n:
                    raise ValueError("no displacement found: repeated keys?")
            displacements[bucket] = d
            for h1, h2, key in groups[bucket]:
                slots[cls._slot(h1, h2, d, n)] = key
        free = iter([i for i, key in enumerate(slots) if key is None])
        for bucket in (b for b in order if len(groups[b]) == 1):
            slot = next(free)
            slots[slot], displacements[bucket] = groups[bucket][0][2], ~slot
        return cls(displacements, slots, [table[key] for key in slots])

    def get(self, key: bytes) -> int | None:
        n = len(self.keys)
        bucket, h1, h2 = self._parts(key, len(self.displacements))
        d = self.displacements[bucket]
        slot = ~d if d < 0 else self._slot(h1, h2, d, n)
        return self.values[slot] if self.keys[slot] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left: a heap of pairs over linked bytes.

    A part starts at i and ends at end[i], where the next part starts. A heap entry is one integer of rank,
    start and stop, which orders by rank and then from the left.
    """
    n, get = len(piece), ranks.get
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    heap = [rank << 64 | i << 32 | i + 2 for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i, stop = entry >> 32 & 0xFFFFFFFF, entry & 0xFFFFFFFF
        middle = end[i]
        if not middle or middle == n or end[middle] != stop:  # one of the two parts has changed since
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := get(piece[i : end[stop]])) is not None:
                heappush(heap, rank << 64 | i << 32 | end[stop])
        if i and (rank := get(piece[before[i] : stop])) is not None:
            heappush(heap, rank << 64 | before[i] << 32 | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder(dict):
    """Pre-token -> packed ids. Repeated pre-tokens come from the memo, others go through the two tiers."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash, pattern: str):
        super().__init__()
        self.ranks, self.whole, self.split = ranks, whole, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        rank = self.whole.get(data)
        ids = [rank] if rank is not None else merge_bytes(data, self.ranks)
        packed = pack(ids)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


_workers: dict[int, object] = {}  # what a Python worker has unpacked from a broadcast, by the broadcast's id


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the ids of the whole text as packed binary. A null text gives an empty binary; other columns stay."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((ranks, PerfectHash.build(ranks)))
    key = shared._jbroadcast.id()

    @F.pandas_udf(T.BinaryType())
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = Encoder(*shared.value, pattern)
        encoder = _workers[key]
        for texts in batches:
            yield pd.Series([encoder.encode(x) for x in texts], dtype=object)

    return df.withColumn(out, ids(text_or_empty(text)))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of packed ids. Null ids give an empty binary; an id outside the vocabulary is an error."""
    spark = df.sparkSession
    bounded_batches(spark)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf(T.BinaryType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = shared.value.__getitem__
        for column in batches:
            yield pd.Series([b"".join(map(at, np.frombuffer(x, "<u4").tolist())) for x in column], dtype=object)

    return df.withColumn(out, text(F.coalesce(F.col(ids), F.lit(b""))))


def default_vocabulary() -> tuple[str, str]:
    """The rank file's path and the pattern that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    path, pattern = default_vocabulary()
    ranks = read_ranks(spark, path)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, ranks, pattern), ranks)
    return both.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
