"""Token counts from flat token files without an index.

A token file is a run of ids with an end-of-document id after each document. It is read as blocks of a fixed
number of ids, wherever documents end. Each block is searched for separators with numpy and leaves, for each
separator, the ids since the one before (or since the block's start), and the ids after its last separator. A
prefix sum over the blocks' separator counts numbers the documents of a file, and the pieces that share a number
are added up: so boundaries are stitched across any number of blocks. The prefix sum has two levels (chunks of
CHUNK blocks, then chunks), so that no task holds a whole file's blocks.

A file that doesn't end with a separator has a last, open document (`closed` is false) if ids are left. Empty
files and blocks have no document, null and empty texts become documents of 0 tokens, and rows that repeat are
documents of their own. Blocks with the same file and number must not repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fxlake.llm import bpe
from fxlake.llm.common import bounded_batches, materialize, read_table

BLOCK_IDS, CHUNK, RUN = 65_536, 1024, 64


def read_token_file(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, ids) of the flat files of little-endian unsigned 32-bit ids under path: a file, folder or glob.

    Each file numbers its blocks, and so its documents, from 0; it may have any length in whole ids (anything else is
    an error). Spark lists the files, and runs of RUN blocks are dealt over the tasks, which read one block at a time
    at its place: so a file of any size is read by many tasks, and a lost task reads its own runs again. Tasks open
    files by pyarrow, which knows local, HDFS, S3 and GCS addresses.
    """
    bounded_batches(spark)
    size = 4 * block_ids
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    last = F.floor((F.col("length") - 1) / size).cast("bigint")
    runs = listed.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(RUN).cast("bigint"))).alias("first"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for file, length, first in zip(pdf["path"], pdf["length"], pdf["first"], strict=True):
                if length % 4:
                    raise ValueError(f"{file} has {length} bytes, which are no whole ids")
                system, name = fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", file), safe=":/@"))
                with system.open_input_file(name) as data:
                    for block in range(first, min(first + RUN, -(-length // size))):
                        yield pd.DataFrame([(file, block, data.read_at(min(size, length - block * size), block * size))], columns=["file", "block", "ids"])

    return runs.repartition(tasks, "path", "first").mapInPandas(read, "file string, block bigint, ids binary")


def pack(df: DataFrame, end_id: int, ids: str = "token_ids", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Flat token files of df's rows in their order: (file, block, ids, closing). One file a partition.

    `closing` lists the row keys (first column) of the documents that end in the block; counting does not read it,
    it only names the counted documents afterwards.
    """
    bounded_batches(df.sparkSession)
    key, size, end = df.columns[0], 4 * block_ids, np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        file, block, held, closing, length = TaskContext.get().partitionId(), 0, [], [], 0
        for pdf in batches:
            out = []
            for name, data in zip(pdf[key], pdf[ids], strict=True):
                held += [data or b"", end]
                length += len(held[-2]) + 4
                cut = length // size
                if cut:
                    stream = b"".join(held)
                    for i in range(cut):
                        ends_here = i == cut - 1 and len(stream) == cut * size
                        out.append((file, block, stream[i * size : (i + 1) * size], closing + [name] * ends_here))
                        block, closing = block + 1, []
                    held = [stream[cut * size :]]
                    length = len(held[0])
                    if not length:
                        continue
                closing.append(name)
            yield pd.DataFrame(out, columns=["file", "block", "ids", "closing"])
        if length:
            yield pd.DataFrame([(file, block, b"".join(held), closing)], columns=["file", "block", "ids", "closing"])

    return df.select(key, ids).mapInPandas(packed, "file bigint, block bigint, ids binary, closing array<bigint>")


def scan(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file, block, n_ends, pieces) and the other columns of blocks but `ids`: the lengths between separators."""
    bounded_batches(blocks.sparkSession)

    @F.pandas_udf("n_ends bigint, pieces array<bigint>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            rows = []
            for data in column:
                ids = np.frombuffer(data or b"", "<u4")
                ends = np.flatnonzero(ids == end_id)
                pieces = np.diff(np.concatenate([[-1], ends])) - 1
                tail = len(ids) - (ends[-1] + 1 if len(ends) else 0)
                rows.append((len(ends), [*pieces.tolist(), int(tail)]))
            yield pd.DataFrame(rows, columns=["n_ends", "pieces"])

    return blocks.withColumn("s", scanned("ids")).select(*[c for c in blocks.columns if c != "ids"], "s.n_ends", "s.pieces")


def _first_numbers(blocks: DataFrame) -> DataFrame:
    """Add `first`, the number of separators of the file before the block: a prefix sum of two levels over n_ends."""
    blocks = blocks.withColumn("chunk", F.floor(F.col("block") / CHUNK))
    chunks = blocks.groupBy("file", "chunk").agg(F.sum("n_ends").alias("n"))
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("file", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("within", F.coalesce(F.sum("n_ends").over(inside), F.lit(0))).join(chunks, ["file", "chunk"])
    return placed.withColumn("first", F.col("start") + F.col("within"))


def count_tokens(scanned: DataFrame) -> DataFrame:
    """(file, document, n_tokens, closed): document k of a file is the k-th from its start, from 0."""
    pieces = _first_numbers(scanned.select("file", "block", "n_ends", "pieces")).select("file", "first", "n_ends", F.posexplode("pieces").alias("place", "length"))
    pieces = pieces.select("file", (F.col("first") + F.col("place")).alias("document"), "length", (F.col("place") < F.col("n_ends")).alias("ends"))
    counted = pieces.groupBy("file", "document").agg(F.sum("length").alias("n_tokens"), F.max("ends").alias("closed"))
    return counted.where("closed or n_tokens > 0")


def named(scanned: DataFrame) -> DataFrame:
    """(file, document, doc_id) from `closing`, which numbers documents as their separators do."""
    placed = _first_numbers(scanned.select("file", "block", "n_ends", "closing"))
    places = placed.select("file", "first", F.posexplode("closing").alias("place", "doc_id"))
    return places.select("file", (F.col("first") + F.col("place")).alias("document"), "doc_id")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, file, document and n_tokens of every document, counted in token files made of the documents."""
    path, pattern = bpe.default_vocabulary()
    ranks = bpe.read_ranks(spark, path)
    end_id = max(ranks.values()) + 1  # free in the vocabulary
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    files = pack(bpe.encode(docs, ranks, pattern), end_id)
    scanned = materialize(scan(files, end_id), "token-scan")
    return count_tokens(scanned).join(named(scanned), ["file", "document"]).select("doc_id", "file", "document", "n_tokens")
