"""Collaborative vectors for items that no model has seen: a ridge from content to collaborative vectors, and a blend with neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fxlake.operators.candidates import l2_normalize
from fxlake.operators.learning import vector_topk

#: Weights are broadcast: no more than this many bytes.
MOST_WEIGHT_BYTES = 256 << 20


@dataclass
class Ridge:
    """weights has a row for each input and one for the bias, a column for each output."""

    weights: np.ndarray
    alpha: float
    rows: int


def _sum_in_tree(parts: DataFrame, add, schema: str) -> DataFrame:
    """Add up one row of sums a partition in three levels, so no task reads more than about the root of their number."""
    width = max(1, int(parts.rdd.getNumPartitions() ** 0.5))
    return parts.repartition(width).mapInPandas(add, schema).repartition(1).mapInPandas(add, schema)


def gram(rows: DataFrame, features: str = "features", targets: str = "targets") -> tuple[np.ndarray, np.ndarray, int]:
    """X'X and X'Y with a column of ones after the features, and the number of rows. Sums are made by tasks, in doubles;
    only the sums (of the model's size) come to the driver. Rows of other lengths, or with nulls, fail the job."""
    schema = "n bigint, p int, k int, xx binary, xy binary"

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, xx, xy = 0, None, None
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"].to_numpy()).astype(np.float64)
                y = np.stack(frame["y"].to_numpy()).astype(np.float64)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                if not (np.isfinite(x).all() and np.isfinite(y).all()):
                    raise ValueError("features and targets must be finite")
                n, xx, xy = n + len(x), x.T @ x + (0 if xx is None else xx), x.T @ y + (0 if xy is None else xy)
        if n:
            yield pd.DataFrame({"n": [n], "p": [xx.shape[0]], "k": [xy.shape[1]], "xx": [xx.tobytes()], "xy": [xy.tobytes()]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for r in frame.itertuples(index=False):
                one = [r.n, np.frombuffer(r.xx).reshape(r.p, r.p), np.frombuffer(r.xy).reshape(r.p, r.k)]
                if total is not None and total[2].shape != one[2].shape:
                    raise ValueError("rows of different lengths")
                total = one if total is None else [a + b for a, b in zip(total, one)]
        if total is not None:
            yield pd.DataFrame({"n": [total[0]], "p": [total[2].shape[0]], "k": [total[2].shape[1]], "xx": [total[1].tobytes()], "xy": [total[2].tobytes()]})

    parts = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("y")).mapInPandas(local, schema)
    row = _sum_in_tree(parts, add, schema).first()
    if row is None:
        return np.zeros((1, 1)), np.zeros((1, 0)), 0
    return np.frombuffer(bytes(row["xx"])).reshape(row["p"], row["p"]), np.frombuffer(bytes(row["xy"])).reshape(row["p"], row["k"]), row["n"]


def fit_ridge(rows: DataFrame, features: str = "features", targets: str = "targets", alpha: float = 1e-2) -> Ridge:
    """Ridge regression with several outputs; the bias has no penalty. At least two rows."""
    xx, xy, n = gram(rows, features, targets)
    if n < 2:
        raise ValueError("a ridge needs at least two rows")
    penalty = np.eye(len(xx)) * alpha
    penalty[-1, -1] = 0.0
    return Ridge(np.linalg.solve(xx + penalty, xy), alpha, n)


def predict_ridge(df: DataFrame, model: Ridge, features: str = "features", out: str = "predicted") -> DataFrame:
    """Add the prediction's unit vector (array<double>): zeros where its norm is 0, null where the features are null."""
    if model.weights.nbytes > MOST_WEIGHT_BYTES:
        raise ValueError("more weights than may be broadcast")
    shared = df.sparkSession.sparkContext.broadcast(model.weights)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = shared.value
        for column in batches:
            known, out = column.notna().to_numpy(), [None] * len(column)
            if known.any():
                x = np.stack(column[known].to_numpy()).astype(np.float64)
                if x.shape[1] + 1 != len(weights):
                    raise ValueError(f"{x.shape[1]} features, the model has {len(weights) - 1}")
                y = x @ weights[:-1] + weights[-1]
                norm = np.linalg.norm(y, axis=1, keepdims=True)
                unit = np.divide(y, norm, out=np.zeros_like(y), where=(norm > 0) & np.isfinite(norm))
                for place, row in zip(np.flatnonzero(known), unit):
                    out[place] = row
            yield pd.Series(out, dtype=object)

    return df.withColumn(out, predict(F.col(features).cast("array<double>")))


def affinity(a: str, b: str) -> Column:
    """How well two products (structs with category, brand, price) go together: same category 1.25, same brand 1.1, prices
    apart by a factor of 2 or more 0.8, of 3 or more 0.6; multiplied. Blank names and prices that aren't positive don't count."""
    equal = lambda n: (F.col(f"{a}.{n}") == F.col(f"{b}.{n}")) & (F.col(f"{a}.{n}") != "")
    x, y = (F.when((F.col(f"{s}.price") > 0) & (F.col(f"{s}.price") < float("inf")), F.col(f"{s}.price")) for s in (a, b))
    ratio = F.greatest(x, y) / F.greatest(F.least(x, y), F.lit(1e-6))
    apart = F.when(x.isNull() | y.isNull(), 1.0).when(ratio >= 3, 0.6).when(ratio >= 2, 0.8).otherwise(1.0)
    return F.when(equal("category"), 1.25).otherwise(1.0) * F.when(equal("brand"), 1.1).otherwise(1.0) * apart


def softmax_weights(similarities: Column, affinities: Column, temperature: float) -> Column:
    """softmax(similarity / temperature + log affinity) of two arrays; equal weights where it isn't finite."""
    logits = F.zip_with(similarities, affinities, lambda s, a: s / max(temperature, 1e-6) + F.ln(F.greatest(a, F.lit(1e-6))))
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    fine = (total > 0) & (total < float("inf"))
    return F.transform(raised, lambda x: F.when(fine, x / total).otherwise(1.0 / F.size(raised)))


def neighbour_sets(cold: DataFrame, products: DataFrame, trained: DataFrame, neighbours: int = 20, least: int = 5, similarity: float = 0.35, temperature: float = 0.07) -> DataFrame:
    """For each cold item its trained neighbours: id, neighbors (array of product_id, similarity, weight, vector), confidence.

    `cold` and `products` have id, vector (content) and facts (a struct of category, brand, price); `trained` has id and vector
    (collaborative). Of the 2 x `neighbours` products nearest by content the trained ones of at least `similarity` count,
    `neighbours` at most. Items with less than `least` of them, or a lower mean similarity, have no row.
    """
    near = vector_topk(cold.select("id", "vector"), products.select("id", "vector"), 2 * neighbours, similarity)
    near = near.join(trained.select(F.col("id").alias("item_id"), l2_normalize(F.col("vector")).alias("cf")).where("cf is not null"), "item_id")
    facts = near.join(cold.select(F.col("id").alias("query_id"), F.col("facts").alias("own")), "query_id").join(products.select(F.col("id").alias("item_id"), F.col("facts").alias("theirs")), "item_id")
    row = F.struct("rank", F.col("item_id").alias("product_id"), F.col("score").alias("similarity"), affinity("own", "theirs").alias("affinity"), F.col("cf").alias("vector"))
    kept = facts.groupBy(F.col("query_id").alias("id")).agg(F.slice(F.sort_array(F.collect_list(row)), 1, neighbours).alias("found"))  # 2 x neighbours at most
    mean = F.aggregate("found", F.lit(0.0), lambda s, x: s + x["similarity"]) / F.size("found")
    kept = kept.where((F.size("found") >= least) & (mean >= similarity))
    weights = softmax_weights(F.transform("found", lambda x: x["similarity"]), F.transform("found", lambda x: x["affinity"]), temperature)
    coverage = F.least(F.lit(1.0), F.size("found") / max(float(neighbours), 1.0))
    both = F.zip_with("found", weights, lambda x, w: F.struct(x["product_id"].alias("product_id"), x["similarity"].alias("similarity"), w.alias("weight"), x["vector"].alias("vector")))
    return kept.select("id", both.alias("neighbors"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean * (0.5 + 0.5 * coverage))).alias("confidence"))


def synthetic_embeddings(sets: DataFrame, predicted: DataFrame, weight: float = 0.65) -> DataFrame:
    """id, vector and confidence of cold items: the unit vector of weight x neighbours + (1 - weight) x ridge, both of unit
    length. `sets` is what `neighbour_sets` gives, `predicted` has id and predicted. A part without a length counts as zeros."""
    summed = F.aggregate("neighbors", F.transform(F.element_at("neighbors", 1)["vector"], lambda x: F.lit(0.0)), lambda s, n: F.zip_with(s, n["vector"], lambda a, b: a + b * n["weight"]))
    zeros = lambda v: F.transform(v, lambda x: F.lit(0.0))
    rows = sets.withColumn("sum", summed).join(predicted.select("id", F.col("predicted").cast("array<double>").alias("p")), "id")
    near, ridge = F.coalesce(l2_normalize(F.col("sum")), zeros("sum")), F.coalesce(l2_normalize(F.col("p")), zeros("sum"))
    share = min(1.0, max(0.0, weight))
    rows = rows.withColumn("blend", F.zip_with(near, ridge, lambda a, b: a * share + b * (1 - share)))
    return rows.select("id", F.coalesce(l2_normalize(F.col("blend")), zeros("blend")).alias("vector"), "confidence")


def content_features(vector: Column, *numbers: Column) -> Column:
    """The content vector at unit length (zeros without one), then the item's numbers."""
    unit = F.coalesce(l2_normalize(vector), F.transform(vector, lambda x: F.lit(0.0)))
    return F.concat(unit, F.array(*[n.cast("double") for n in numbers])) if numbers else unit

