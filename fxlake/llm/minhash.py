"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes the set of its 5-word shingles (64-bit hashes), a signature of 96 minima, a sketch of their
   lowest bytes, and 24 band keys of four minima each. A pair at similarity 0.85 shares no band with a chance
   below 2e-8.
2. Texts with equal sets are one class, represented by the smallest id; only representatives go on.
3. First round: within each bucket (band and key) every member is paired with the smallest member and with its
   neighbour in the order of set sizes. That is linear in the bucket's size, whatever it is.
4. Pairs are verified batch by batch: after each batch of 16 sketch bytes a pair goes if the posterior probability
   of similarity >= 0.85 (uniform prior) is below the chosen miss probability. Survivors are compared on full sets.
   Verified links make components.
5. Second round: pairs within one component can't change it, so only buckets that still hold several components
   matter. There, members outside the bucket's largest component meet all members, in blocks of bounded size, and
   only pairs that survive the Bayesian test and a comparison of shortened sets leave the task. They are verified on
   full sets, and the links of both rounds make the final components. No candidate pair between different components is left out.

Null and empty texts have an empty set and are linked with nothing. Repeated rows and ties are kept; each row of
the input gives one row. Null ids form components of their own (null).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.llm.common import bounded_batches, materialize, read_table, text_or_empty
from fxlake.llm.components import connected_components
from fxlake.llm.words import WordHashes, hash_words, shingle_hashes, words_of

BANDS, ROWS, BATCH = 24, 4, 16
HASHES = BANDS * ROWS
MISS = 1e-5
#: Members of a bucket that one task compares at a time.
BLOCK = 1024

#: Ids of texts to verify are broadcast up to so many (16 MB); beyond, the texts are shuffled to meet them.
BROADCAST_IDS = 1_000_000
#: Bytes of a shingle hash that full sets keep: two sets of a thousand shingles differ by chance equality with a
#: chance below 1e-8.
SET_BYTES = 6

SIGNED = "n_shingles bigint, set_hash binary, sketch binary, bands array<bigint>"
_memo = WordHashes()


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[at : at + 1024, None] * multipliers).min(0), out)
    return out


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of compared bytes 16, 32, ... 96: with fewer matches the posterior probability that the
    similarity reaches the threshold is below `miss`. With a uniform prior it is P(Binomial(n + 1, t) <= matches)."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < miss:
            m += 1
        out.append(m)
    return out


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(hash_words(words_of(text), _memo)))


def _set_hash(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


def sign(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the figures of step 1 to each row."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(SIGNED)
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        multipliers = _multipliers()
        for texts in batches:
            rows = []
            for t in texts:
                shingles = shingle_set(t)
                if not len(shingles):
                    rows.append((0, b"", b"", []))
                    continue
                minima = signature(shingles, multipliers)
                keys = [xxhash.xxh3_64_intdigest(minima[i : i + ROWS].tobytes(), i) - 2**63 for i in range(0, HASHES, ROWS)]
                rows.append((len(shingles), _set_hash(shingles), (minima >> np.uint64(40)).astype(np.uint8).tobytes(), keys))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_hash", "sketch", "bands"])

    return docs.withColumn("signed", signed(text_or_empty(text))).select(*docs.columns, "signed.*")


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), HASHES)


def _bayes(pairs: DataFrame, threshold: float) -> DataFrame:
    """Keep pairs (a, b, left, right) whose sketches pass every batch."""
    least = least_matches(threshold)

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            left, right = _sketches(pdf["left"]), _sketches(pdf["right"])
            alive, matches = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (left[alive, part] == right[alive, part]).sum(1)
                alive = alive[matches[alive] >= need]
            yield pdf.iloc[alive][["a", "b"]]

    return pairs.mapInPandas(passed, "a bigint, b bigint")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int = SET_BYTES) -> DataFrame:
    """(rep, shingles) of the texts of wanted(rep, set_hash), computed anew from docs(doc_id, text); `width` bytes a
    shingle. A map over batches, not a function in a projection: it runs on the joined rows only."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rep, text in zip(pdf["rep"], pdf["text"], strict=True):
                shingles = shingle_set(text)
                kept = shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
                rows.append((rep, _set_hash(shingles), kept.tobytes()))
            yield pd.DataFrame(rows, columns=["rep", "set_hash", "shingles"])

    ids = wanted.select(F.col("rep").alias("doc_id"))
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), text_or_empty().alias("text"))
    made = texts.mapInPandas(sets, "rep bigint, set_hash binary, shingles binary")
    # an id may come with several texts: only the one that stands for its class counts
    return materialize(made.join(wanted, ["rep", "set_hash"], "left_semi").dropDuplicates(["rep"]).drop("set_hash"), "sets")


def _read_set(packed: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(packed) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _common(left: np.ndarray, right: np.ndarray) -> int:
    both = np.concatenate([left, right])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Keep pairs (a, b) whose full sets are similar enough."""
    percent = round(threshold * 100)
    sizes = reps.select("rep", "n_shingles")
    near = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    near = materialize(near.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"), "near")
    wanted = reps.select("rep", "set_hash").join(near.select(F.col("a").alias("rep")).union(near.select("b")).distinct(), "rep", "left_semi")
    sets = _full_sets(docs, materialize(wanted, "wanted"))
    one, two = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right"))

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for left, right in zip(pdf["left"], pdf["right"], strict=True):
                common = _common(_read_set(left, SET_BYTES), _read_set(right, SET_BYTES))
                keep.append(100 * common >= percent * ((len(left) + len(right)) // SET_BYTES - common))
            yield pdf.loc[keep, ["a", "b"]]

    return near.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInPandas(linked, "a bigint, b bigint")


def _first_pairs(members: DataFrame) -> DataFrame:
    """Star and chain of each bucket in one sorted pass over members(key, rep, n): a task holds two rows."""

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = first = last = None
        for pdf in batches:
            keys, reps = pdf["key"].to_numpy(), pdf["rep"].to_numpy()
            pairs = []
            for k, rep in zip(keys.tolist(), reps.tolist(), strict=True):
                if k != key:
                    key, first = k, rep
                else:
                    pairs.append((first, rep, k))
                    if last != first:
                        pairs.append((last, rep, k))
                last = rep
            yield pd.DataFrame(pairs, columns=["a", "b", "key"])

    return members.repartition("key").sortWithinPartitions("key", "n", "rep").mapInPandas(walked, "a bigint, b bigint, key bigint")


def _second_pairs(members: DataFrame, docs: DataFrame, reps: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Links between different components that share a bucket: pairs that pass the Bayesian test and agree on full sets.

    members(key, rep) of buckets with several members; labels(rep, component). Each bucket's members outside its
    largest component are the `few`; cells of (block of few, block of all) go to tasks, at most 2 x BLOCK rows each.
    A pair is looked at in the first bucket that it shares. Rows bring their full sets, so what passes is a link; of
    the links of one of the few with one component one leaves the task, as all of them connect the same two.
    """
    least, percent = least_matches(threshold), round(threshold * 100)
    labelled = members.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("size"))
    shape = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"))
    shape = shape.where("all > top.size").select(
        "key",
        F.col("top.component").alias("main"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("columns"),
        F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int").alias("rows"),
    )
    cells = materialize(labelled.join(shape, "key"), "cells")
    wanted = materialize(reps.select("rep", "set_hash").join(cells.select("rep").distinct(), "rep", "left_semi"), "wanted")
    cells = cells.join(reps.select("rep", "sketch", "bands"), "rep").join(_full_sets(docs, wanted, SET_BYTES), "rep")
    place = lambda n: F.pmod(F.xxhash64("rep", "key"), F.col(n)).cast("int")
    every = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), place("columns").alias("column"), F.lit(False).alias("few"))
    few = cells.where("component <> main").select("*", place("rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), F.lit(True).alias("few"))

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted by cell; one cell is held at a time."""
        held: list[pd.DataFrame] = []
        cell = None
        for pdf in batches:
            marks = pdf[["key", "row", "column"]].to_numpy()
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(pdf)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                if held and tuple(marks[start]) != cell:
                    yield compare(pd.concat(held))
                    held = []
                cell = tuple(marks[start])
                held.append(pdf.iloc[start:stop])
        if held:
            yield compare(pd.concat(held))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        key, is_few = pdf["key"].iloc[0], pdf["few"].to_numpy()
        reps, groups, sketches = pdf["rep"].to_numpy(), pdf["component"].to_numpy(), _sketches(pdf["sketch"])
        bands, sets = np.stack(pdf["bands"].to_numpy()), pdf["shingles"].to_numpy()
        sizes = np.array([len(x) // SET_BYTES for x in sets])
        band = int((bands[0] == key).argmax())
        one, two = np.flatnonzero(is_few), np.flatnonzero(~is_few)
        out = set()
        for i in one:
            alive = two[groups[two] != groups[i]]
            alive = alive[(bands[alive, :band] != bands[i, :band]).all(1)]
            alive = alive[100 * np.minimum(sizes[alive], sizes[i]) >= percent * np.maximum(sizes[alive], sizes[i])]
            matches = np.zeros(len(alive), np.int64)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches += (sketches[alive, part] == sketches[i, part]).sum(1)
                alive, matches = alive[matches >= need], matches[matches >= need]
            mine, done = _read_set(sets[i], SET_BYTES), set()
            for j in alive[np.argsort(-matches, kind="stable")]:
                if groups[j] not in done:
                    common = _common(mine, _read_set(sets[j], SET_BYTES))
                    if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                        done.add(groups[j])
                        out.add((min(reps[i], reps[j]), max(reps[i], reps[j])))
        return pd.DataFrame(sorted(out), columns=["a", "b"])

    columns = ["key", "row", "column", "few", "rep", "component", "sketch", "bands", "shingles"]
    dealt = every.select(*columns).unionByName(few.select(*columns)).repartition("key", "row", "column")
    return dealt.sortWithinPartitions("key", "row", "column").mapInPandas(met, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.85) -> DataFrame:
    """docs with n_shingles, component_id (the smallest id reachable over links, itself included) and kept."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(sign(docs).drop("text"), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "set_hash"), ["doc_id", "set_hash"], "left_semi")
    reps = materialize(reps.withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "set_hash"]), "reps")
    sketches = reps.select("rep", "sketch")
    banded = reps.select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n"))
    walked = materialize(_first_pairs(banded), "walked")
    pairs = walked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    left, right = (sketches.select(F.col("rep").alias(c), F.col("sketch").alias(s)) for c, s in (("a", "left"), ("b", "right")))
    links = materialize(_verify(_bayes(pairs.join(left, "a").join(right, "b"), threshold), docs, reps, threshold), "links")
    first = connected_components(links)
    members = walked.select("key", F.col("a").alias("rep")).union(walked.select("key", F.col("b").alias("rep"))).distinct()
    bridges = materialize(_second_pairs(members, docs, reps, first.select(F.col("node").alias("rep"), "component"), threshold), "bridges")
    whole = connected_components(links.union(bridges)).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    ids = signed.select("doc_id", "n_shingles", "set_hash").join(classes, "set_hash", "left").join(whole, "rep", "left")
    ids = ids.select("doc_id", "n_shingles", F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
    return ids.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
