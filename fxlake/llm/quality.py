"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is cut into blocks,
each block is compressed with both, and the difference of the two sizes, divided by the text's length, says
which side the text is like. A logistic calibration, fitted on labelled rows that the dictionaries haven't
seen, makes a score of it; its inputs are that difference, the same over the sum of the sizes, and the log of
the better ratio (text that compresses to almost nothing differs little between the dictionaries).

Only the text is scored: equal texts get equal scores. Null and empty texts have a difference of 0 and get
the calibration's value for it. With no labelled row of one class, every text gets the share of label 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fxlake.llm.common import bounded_batches, materialize, read_table, release, text_or_empty

FOLDS = 5


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit: at most `rows` labelled rows of each class for the dictionaries, `calibration_rows` rows
    for the calibration, and `sample_bytes` bytes of text for either."""

    rows: int = 3000
    calibration_rows: int = 3000
    sample_bytes: int = 32 << 20
    dictionary_bytes: int = 112_640
    dictionary_blocks: int = 4000
    block_bytes: int = 1024
    level: int = 3


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    weights: tuple[float, ...]  # empty: no calibration, only the prior
    means: tuple[float, ...]
    scales: tuple[float, ...]
    prior: float
    settings: Settings


def fold(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def blocks(text: str, size: int) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + size] for i in range(0, len(data), size)]


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)


class Sizer:
    """The three figures of a text from its compressed sizes."""

    def __init__(self, model: Model):
        self.bad, self.good = (_compressor(x, model.settings.level) for x in (model.bad, model.good))
        self.empty, self.size = len(self.bad.compress(b"")), model.settings.block_bytes

    def figures(self, text: str) -> tuple[float, float, float]:
        bad = good = length = 0
        for block in blocks(text, self.size):
            bad += len(self.bad.compress(block)) - self.empty
            good += len(self.good.compress(block)) - self.empty
            length += len(block)
        if not length:
            return 0.0, 0.0, 0.0
        return (bad - good) / length, (bad - good) / max(1, bad + good), math.log((min(bad, good) + 1) / length)


def _expand(figures: np.ndarray) -> np.ndarray:
    difference, share, ratio = figures.T
    return np.stack([difference, share, ratio, ratio * ratio, difference * ratio], 1)


def _dictionary(texts: list[str], settings: Settings, seen: Counter) -> bytes:
    """Train on lines that one text of the sample has: lines of many texts tell nothing about either side."""
    own = ["\n".join(line for line in text.split("\n") if seen[line] == 1) for text in texts]
    cut = [block for text in own for block in blocks(text, settings.block_bytes)]
    cut = [cut[int(i)] for i in np.random.default_rng(0).permutation(len(cut))[: settings.dictionary_blocks]]
    size = min(settings.dictionary_bytes, max(256, sum(map(len, cut)) // 4))
    try:
        return zstandard.train_dictionary(size, cut).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: the text itself is the dictionary
        return b"".join(cut)[: settings.dictionary_bytes] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    means, scales = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - means) / scales]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty * np.eye(len(w)), z.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w, means, scales


def _samples(docs: DataFrame, parts: dict[str, tuple[DataFrame, int]], limit_bytes: int, text: str) -> dict[str, list[tuple[int, str]]]:
    """(quality, text) of each part's sample. A part is (labelled rows, most rows): those of the smallest hashes of doc_id,
    and of these the first whose texts fit into `limit_bytes`. Ids and sizes are chosen before a text leaves its task; of
    the texts of a repeated id the shortest counts. All parts share one scan for the sizes and one for the texts."""
    chosen = reduce(DataFrame.unionByName, [labels.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("part", F.lit(part)) for part, (labels, rows) in parts.items()])
    texts = docs.select("doc_id", text_or_empty(text).alias("text"))
    keys = ["part", "doc_id", "quality"]
    sized = texts.join(F.broadcast(chosen), "doc_id").groupBy(*keys).agg(F.min(F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"))).alias("t"))
    running = F.sum("t.size").over(Window.partitionBy("part").orderBy(F.xxhash64("doc_id"), "doc_id"))  # over a part's rows at most
    fitting = sized.withColumn("total", running).where(F.col("total") <= limit_bytes).select(*keys, F.col("t.hash").alias("hash"))
    fitting = materialize(fitting, "quality-sample")
    found = texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(fitting), ["doc_id", "hash"]).groupBy(*keys).agg(F.min("text").alias("text"))
    out: dict[str, list[tuple[int, str]]] = {part: [] for part in parts}
    for row in sorted(found.collect(), key=lambda r: r.doc_id):
        out[row.part].append((row.quality, row.text))
    release(fitting, shuffles=False)
    return out


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text") -> Model:
    """Fit on labelled rows outside fold 0: folds 1 to 3 for the dictionaries, fold 4 for the calibration.

    Labels other than 0 and 1 and null ids are passed over; of several labels of one id the smallest holds.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.withColumn("fold", fold(F.col("doc_id")))
    words = known.where(F.col("fold").between(1, 3))
    parts = {"bad": (words.where("quality = 0"), settings.rows), "good": (words.where("quality = 1"), settings.rows), "calibration": (known.where("fold = 4"), settings.calibration_rows)}
    samples = _samples(docs, parts, settings.sample_bytes, text)
    texts = {q: [t for _, t in samples[part]] for q, part in ((0, "bad"), (1, "good"))}
    calibration = samples["calibration"]
    seen = Counter(line for group in texts.values() for t in group for line in set(t.split("\n")))
    labelled = [q for q, _ in calibration] or [q for q in texts for _ in texts[q]]
    prior = float(np.mean(labelled)) if labelled else 0.5
    model = Model(_dictionary(texts[0], settings, seen), _dictionary(texts[1], settings, seen), (), (), (), prior, settings)
    if not texts[0] or not texts[1] or len({q for q, _ in calibration}) < 2:
        return model
    sizer = Sizer(model)
    weights, means, scales = _logistic(_expand(np.array([sizer.figures(t) for _, t in calibration])), np.array([q for q, _ in calibration], float))
    return Model(model.bad, model.good, tuple(weights), tuple(means), tuple(scales), prior, settings)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of the whole text, from 0 to 1. Other columns stay."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        sizer = Sizer(m)
        for texts in batches:
            if not m.weights:
                yield pd.Series(np.full(len(texts), m.prior))
                continue
            x = _expand(np.array([sizer.figures(t) for t in texts], float).reshape(-1, 3))
            z = m.weights[0] + ((x - np.array(m.means)) / np.array(m.scales)) @ np.array(m.weights[1:])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return df.withColumn(out, scored(text_or_empty(text)))


#: A text of at least this score counts as good.
THRESHOLD = 0.3


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
