"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, and how often they end together.

Tokenizer A (byte-level BPE) reads space + text, tokenizer B (pieces with byte fallback) reads the text and puts the
space itself. Byte offsets where tokens of both end cut the text into groups; the last tokens of a group are a link.

Most groups are one token of A and one of B with equal bytes. An array from A's ids to B's ids of the same bytes is made
beforehand, so such a group is a count in a vector as long as A's vocabulary: one vector a task, summed in a tree. Only
the links of the other groups enter the shuffle of pairs, already added up by task.

A document's counts are looked up in three ways: vectors (at most one number for each id), pairs that have at least one
in HOT_PAIRS of all irregular links (so there are at most HOT_PAIRS of them), and a join for the rest, of which no pair
is frequent. No row is left out and none depends on the size of the input.

Defined results: a null or empty text, or one that B's normaliser changes (its pieces don't spell the text), has no
tokens and zeros. Repeated rows count each time. Rows without an id are kept. Other columns than the id and the text
are left out, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.llm import bpe
from fxlake.llm.common import bounded_batches, materialize, read_table

#: Irregular pairs with at least this part of all irregular links are broadcast: no more than this many.
HOT_PAIRS = 1 << 16
#: Distinct pairs that a task adds up before it passes them on.
TASK_PAIRS = 1 << 20
#: tiktoken's splitter recurses over white space; longer runs go through the two-tier encoder, which gives the same ids.
LONG_SPACE = re.compile(r"\s{20000}")


def _byte_of() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in printable}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}


@dataclass
class Pair:
    """Both tokenizers' files, as they are broadcast (a few MB: `read_pair` checks), and what is derived from them."""

    ranks: dict[bytes, int]
    pattern: str
    model: bytes

    @cached_property
    def _a(self):
        import tiktoken

        return tiktoken.Encoding("a", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def _slow_a(self) -> bpe.Encoder:
        return bpe.Encoder(self.ranks, bpe.PerfectHash.build(self.ranks), self.pattern)

    @cached_property
    def _b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    @cached_property
    def bytes_a(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    @cached_property
    def bytes_b(self) -> list[bytes]:
        def spelled(piece: str) -> bytes:
            single = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
            return bytes([int(single[1], 16)]) if single else piece.replace("▁", " ").encode()

        return [spelled(self._b.id_to_piece(i)) for i in range(self._b.get_piece_size())]

    @cached_property
    def same(self) -> np.ndarray:
        """A's id -> B's id of the same bytes, or -1. A whole piece goes before a byte piece, then the lower id."""
        by_bytes: dict[bytes, int] = {}
        for i in sorted(range(len(self.bytes_b)), key=lambda i: (self._b.is_byte(i), i)):
            if not (self._b.is_control(i) or self._b.is_unknown(i)):
                by_bytes.setdefault(self.bytes_b[i], i)
        return np.array([by_bytes.get(x, -1) if x else -1 for x in self.bytes_a], dtype=np.int64)

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))

    @cached_property
    def words(self) -> list[bytes]:
        """What an id becomes in the list of groups: 2 * id + (last of its group), B's after all of A's."""
        return [b"%d%c" % (i, end) for n, last in ((len(self.bytes_a), b"|"), (len(self.bytes_b), b";")) for i in range(n) for end in (ord(","), last[0])]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both, empty where the tokens don't spell space + text."""
        if not text:
            return [], []
        spaced = " " + text
        wanted = spaced.encode("utf-8", "surrogatepass")
        b = self._b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != wanted:
            return [], []
        a = np.frombuffer(self._slow_a.encode(spaced), "<u4").tolist() if LONG_SPACE.search(spaced) else self._a.encode_ordinary(spaced)
        return (a, b) if b"".join(map(self.bytes_a.__getitem__, a)) == wanted else ([], [])

    def groups(self, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """For each group its last tokens of A and of B and whether it is one to one, and all groups as text."""
        ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        end_a, end_b = self.lengths[0][ids_a].cumsum(), self.lengths[1][ids_b].cumsum()
        place = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[np.minimum(place, len(end_b) - 1)] == end_a)
        last_b = place[last_a]
        one = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
        codes_a, codes_b = 2 * ids_a, 2 * (ids_b + len(self.bytes_a))
        codes_a[last_a] += 1
        codes_b[last_b] += 1
        # A's tokens of a group stand before B's: each is moved by the other's tokens of earlier groups, or up to this one
        before_b = np.concatenate(([0], last_b + 1))[np.searchsorted(last_a, np.arange(len(ids_a)))]
        upto_a = (last_a + 1)[np.searchsorted(last_b, np.arange(len(ids_b)))]
        both = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        both[np.arange(len(ids_a)) + before_b] = codes_a
        both[np.arange(len(ids_b)) + upto_a] = codes_b
        return ids_a[last_a], ids_b[last_b], one, b"".join(map(self.words.__getitem__, both.tolist()))[:-1]


def read_pair(path_a: str, path_b: str, pattern: str) -> Pair:
    """A from its JSON file (ids must follow the order of merges, so that they serve as ranks), B from its model file."""
    for path in (path_a, path_b):
        if os.path.getsize(path) > bpe.MAX_VOCABULARY_BYTES:
            raise ValueError(f"vocabulary file above {bpe.MAX_VOCABULARY_BYTES} bytes: {path}")
    with open(path_a, encoding="utf-8") as file:
        data = json.load(file)
    model, special, byte_of = data["model"], {x["content"] for x in data["added_tokens"]}, _byte_of()
    if data["normalizer"] is not None or data["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or model["type"] != "BPE":
        raise ValueError(f"not a plain byte-level BPE: {path_a}")
    merged = [model["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"ids don't follow the merges: {path_a}")
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    with open(path_b, "rb") as file:
        return Pair(ranks, pattern, file.read())


_workers: dict[int, Pair] = {}


def _unpacked(shared) -> Pair:
    key = shared.key
    if key not in _workers:
        _workers.clear()
        _workers[key] = Pair(*shared.value.value)
    return _workers[key]


@dataclass
class _Shared:
    value: object
    key: int


def _smallest(values: int) -> str:
    return "<u2" if values <= 1 << 16 else "<u4" if values <= 1 << 32 else "<u8"


def encode_groups(df: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over the texts. A row for each document (kind 0: its numbers, the packed A ids of one-to-one groups and
    the packed a * size of B + b of other links), one for each task with its vector (kind 1), and the task's irregular
    pairs with their counts (kind 2)."""
    bounded_batches(df.sparkSession)
    handle = df.sparkSession.sparkContext.broadcast((pair.ranks, pair.pattern, pair.model))
    shared = _Shared(handle, handle._jbroadcast.id())
    size_a, size_b = len(pair.bytes_a), len(pair.bytes_b)
    type_a, type_pair = _smallest(size_a), _smallest(size_a * size_b)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, vector, held, pending = _unpacked(shared), np.zeros(size_a, dtype=np.int64), [], 0
        keys, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def added_up():
            every = np.concatenate([keys, *held])
            weights = np.concatenate([counts, np.ones(len(every) - len(keys), dtype=np.int64)])
            distinct, place = np.unique(every, return_inverse=True)
            return distinct, np.bincount(place, weights, len(distinct)).astype(np.int64)

        def pairs(keys, counts):
            return pd.DataFrame({"kind": 2, "row": None, "doc_id": None, "n_a": None, "n_b": None, "n_groups": None, "groups_sha256": None, "same": None, "odd": None, "pair": keys, "n": counts})

        for frame in frames:
            rows = []
            for row, id_, words in zip(frame["row"], frame["doc_id"], frame["text"]):
                a, b = both.encode(words)
                if not a:
                    rows.append((row, id_, 0, 0, 0, "", b"", b""))
                    continue
                last_a, last_b, one, spelled = both.groups(a, b)
                regular = one & (both.same[last_a] == last_b)
                equal, odd = last_a[regular], last_a[~regular] * size_b + last_b[~regular]
                np.add.at(vector, equal, 1)
                held.append(odd)
                pending += len(odd)
                rows.append((row, id_, len(a), len(b), len(last_a), hashlib.sha256(spelled).hexdigest(), equal.astype(type_a).tobytes(), odd.astype(type_pair).tobytes()))
            out = pd.DataFrame(rows, columns=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "same", "odd"])
            out["doc_id"] = pd.array(frame["doc_id"].array, dtype="Int64") if len(out) else out["doc_id"]
            yield out.assign(kind=0, pair=None, n=None)
            if pending > TASK_PAIRS:
                keys, counts = added_up()
                held, pending = [], 0
                if len(keys) > TASK_PAIRS:
                    yield pairs(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        keys, counts = added_up()
        for start in range(0, len(keys), 1 << 16):
            yield pairs(keys[start : start + (1 << 16)], counts[start : start + (1 << 16)])
        if vector.any():
            yield pairs([None], [None]).assign(kind=1, same=[vector.astype("<i8").tobytes()])

    schema = "kind int, row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, same binary, odd binary, pair bigint, n bigint"
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(read, schema)


def sum_vectors(vectors: DataFrame, length: int) -> np.ndarray:
    """The sum of packed vectors of one column, in a tree of three levels; only the last vector comes to the driver."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(length, dtype=np.int64)
        for frame in frames:
            for packed in frame["same"]:
                total += np.frombuffer(packed, "<i8")
        if total.any():
            yield pd.DataFrame({"same": [total.astype("<i8").tobytes()]})

    first = vectors.mapInPandas(add, "same binary")
    width = max(1, int(first.rdd.getNumPartitions() ** 0.5))
    row = first.repartition(width).mapInPandas(add, "same binary").repartition(1).mapInPandas(add, "same binary").first()
    return np.zeros(length, dtype=np.int64) if row is None else np.frombuffer(row["same"], "<i8")


def align(df: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents' numbers, and the pairs of ids with their counts: (a, b, n)."""
    spark = df.sparkSession
    size_a, size_b = len(pair.bytes_a), len(pair.bytes_b)
    stored = materialize(encode_groups(df, pair, doc_id, text), "alignment")
    vector = sum_vectors(stored.where("kind = 1").select("same"), size_a)
    pairs = materialize(stored.where("kind = 2").groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")

    highest = np.zeros(size_b, dtype=np.int64)
    regular = np.flatnonzero(vector)
    highest[pair.same[regular]] = vector[regular]  # different ids of A have different bytes
    for r in pairs.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("n")).collect():  # one row an id of B at most
        highest[r["b"]] = max(highest[r["b"]], r["n"])
    total = pairs.agg(F.sum("n")).first()[0] or 0
    often = sorted((r["pair"], r["n"]) for r in pairs.where(F.col("n") * HOT_PAIRS >= total).collect())  # HOT_PAIRS rows at most
    hot = np.array([x for x, _ in often], dtype=np.int64), np.array([n for _, n in often], dtype=np.int64)
    best_same = vector * (pair.same >= 0) * (vector == highest[pair.same])
    shared = spark.sparkContext.broadcast((vector, best_same > 0, highest, *hot))
    type_a, type_pair = _smallest(size_a), _smallest(size_a * size_b)

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, best, highest, hot_pairs, hot_counts = shared.value
        for frame in frames:
            rows = []
            for same, odd in zip(frame.pop("same"), frame.pop("odd")):
                same, odd = np.frombuffer(same, type_a), np.frombuffer(odd, type_pair).astype(np.int64)
                n_best, count_sum = int(best[same].sum()), int(counts[same].sum())
                place = np.searchsorted(hot_pairs, odd)
                known = np.zeros(len(odd), dtype=bool)
                if len(hot_pairs):
                    known = hot_pairs[np.minimum(place, len(hot_pairs) - 1)] == odd
                    found = hot_counts[place[known]]
                    count_sum += int(found.sum())
                    n_best += int((found == highest[odd[known] % size_b]).sum())
                rest, times = np.unique(odd[~known], return_counts=True)
                rows.append((n_best, count_sum, rest, times))
            yield frame.assign(**dict(zip(("n_best", "count_sum", "rest", "times"), zip(*rows)))) if rows else frame.assign(n_best=[], count_sum=[], rest=[], times=[])

    schema = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_best bigint, count_sum bigint, rest array<bigint>, times array<bigint>"
    numbers = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    looked = materialize(stored.where("kind = 0").select(*numbers, "same", "odd").mapInPandas(look_up, schema), "alignment-rows")
    top = spark.createDataFrame([(int(b), int(highest[b])) for b in np.flatnonzero(highest)], "b bigint, top bigint")  # ids of B
    rare = pairs.where(F.col("n") * HOT_PAIRS < total).withColumn("b", F.col("pair") % size_b)
    rare = rare.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("is_best"))
    links = looked.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.times").alias("times"))
    rest = links.join(rare, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("is_best")).alias("b2"), F.sum(F.col("times") * F.col("n")).alias("s2"))
    zero = F.lit(0)
    documents = looked.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), (F.col("n_best") + F.coalesce("b2", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("s2", zero)).alias("count_sum"), "groups_sha256",
    )
    ones = spark.createDataFrame([(int(i), int(pair.same[i]), int(vector[i])) for i in regular], "a bigint, b bigint, n bigint")
    return documents, ones.unionByName(pairs.select(F.floor(F.col("pair") / size_b).cast("long").alias("a"), (F.col("pair") % size_b).alias("b"), "n"))


def default_pair() -> Pair:
    """The files and the pattern that the contract names."""
    import public_tokenizers

    return read_pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    return align(read_table(spark, sf_dir, "documents").select("doc_id", "text"), default_pair())[0]
