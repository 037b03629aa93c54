"""Slates, negatives, labels, values, ranking metrics, vectors, and quality reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fxlake.functions.batches import changes, whole_groups
from fxlake.operators.candidates import dot, l2_normalize
from fxlake.session import ship_package

RELEVANCE = {"purchase": 3, "add_to_cart": 2, "click": 1}


def relevance(action: Column) -> Column:
    return reduce(lambda tail, x: F.when(action == x[0], F.lit(x[1])).otherwise(tail), RELEVANCE.items(), F.lit(0))


# ---------------------------------------------------------------- slates and negatives


def ltr_samples(slates: DataFrame, feedback: DataFrame) -> DataFrame:
    """Slate rows with the strongest interaction of their impression, product and user; none means a `view`.
    Ties go to the latest, then to the largest event id."""
    best = feedback.groupBy("impression_id", "product_id", "user_id").agg(F.max_by(F.struct("action", "value"), F.struct(relevance(F.col("action")), "occurred_at", "event_id")).alias("b"))
    out = slates.join(best, ["impression_id", "product_id", "user_id"], "left")
    return out.select("impression_id", "user_id", "product_id", "position", "combined_score", F.coalesce("b.action", F.lit("view")).alias("action"), F.col("b.value").alias("value"), relevance(F.coalesce("b.action", F.lit("view"))).alias("relevance"))


def graded_slates(slates: DataFrame, feedback: DataFrame) -> DataFrame:
    """Slate rows with the relevance that `ltr_samples` gives: the highest one of their interactions. Whole numbers are
    hashed, where the strongest interaction itself is found by sorting."""
    keys = ["impression_id", "product_id", "user_id"]
    best = feedback.groupBy(*keys).agg(F.max(relevance(F.col("action"))).alias("relevance"))
    return slates.select(*keys, "combined_score").join(best, keys, "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def impression_negatives(slates: DataFrame, feedback: DataFrame, weight: float = 0.25) -> DataFrame:
    """Slate rows without a positive."""
    keys = ["impression_id", "product_id", "user_id"]
    return slates.join(feedback.select(*keys).distinct(), keys, "left_anti").select("user_id", "product_id", F.lit("impression").alias("source"), F.lit(weight).alias("weight"), F.lit(True).alias("exposed"))


def rejected_negatives(impressions: DataFrame, feedback: DataFrame, weight: float = 0.15, most: int = 50) -> DataFrame:
    """The candidates that an impression's context (JSON text) names as rejected by the ranker: its first `most` entries, of
    which those that are no object or have no product are passed over; one row for an impression, user and product, without
    those with positive feedback on the impression."""
    listed = F.slice(F.try_variant_get(F.try_parse_json("context"), "$.rejected_candidate_items", "array<variant>"), 1, most)
    named = F.transform(listed, lambda x: F.trim(F.try_variant_get(x, "$.product_id", "string")))  # null for what is no object
    # lists of at most `most` products are made unique and lessened as they are; only what is left becomes rows
    keys = ["impression_id", "user_id"]
    lists = impressions.select(*keys, F.array_distinct(F.filter(named, lambda p: p != "")).alias("l")).groupBy(*keys).agg(F.flatten(F.collect_list("l")).alias("l"))
    liked = feedback.where("product_id is not null").groupBy(*keys).agg(F.collect_set("product_id").alias("liked"))
    left = F.when(F.col("liked").isNull(), F.array_distinct("l")).otherwise(F.array_except("l", "liked"))
    rows = lists.join(liked, keys, "left").select("user_id", F.explode(left).alias("product_id"))
    return rows.select("user_id", "product_id", F.lit("rejected").alias("source"), F.lit(weight).alias("weight"), F.lit(False).alias("exposed"))


def all_negatives(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def flatten_slates(slates: DataFrame, now: float, days: int, impressions: int) -> DataFrame:
    """The rows of the newest impressions of the last days."""
    recent = slates.where(F.col("created_at") >= now - 86400 * days).groupBy("impression_id").agg(F.max("created_at").alias("t")).orderBy(F.desc("t"), "impression_id").limit(impressions)
    return slates.join(F.broadcast(recent), "impression_id").drop("t")  # at most `impressions` rows


def attach_window_features(rows: DataFrame, windows: DataFrame, entity: str, key: str, names: tuple[str, ...] = ("5m", "1h", "24h")) -> DataFrame:
    """The latest window of each length for an entity, one column each; missing ones are 0."""
    last = windows.where(F.col("entity_type") == entity).groupBy("entity_id", "window").agg(F.max_by(F.struct("views", "clicks", "purchases", "total_events"), "window_end").alias("w"))
    wide = last.groupBy(F.col("entity_id").alias(key)).pivot("window", list(names)).agg(F.first("w"))
    columns = [F.coalesce(F.col(f"`{n}`.{c}"), F.lit(0)).alias(f"{entity}_{n}_{c}") for n in names for c in ("views", "clicks", "purchases", "total_events")]
    return rows.join(wide, key, "left").select(*rows.columns, *columns)


def attach_training_metadata(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Catalog facts, with defaults where the catalog has none."""
    facts = products.select("product_id", "category", "brand", "price", "rating", "num_reviews", "in_stock")
    out = rows.join(facts, "product_id", "left")
    filled = {"category": "unknown", "brand": "unknown", "price": 0.0, "rating": 0.0, "num_reviews": 0}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in filled.items()} | {"in_stock": F.coalesce("in_stock", F.lit(True))})


def displayed_snapshots(slates: DataFrame) -> DataFrame:
    """Per slate row: place by combined score, whether all scores are there, and a hash of the row's features."""
    order = Window.partitionBy("impression_id").orderBy(F.desc("combined_score"), "product_id")
    names = ("collaborative_score", "content_similarity_score", "popularity_score")
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in names])
    digest = F.sha2(F.concat_ws("|", "impression_id", "product_id", *[F.format_string("%.6f", F.col(c)) for c in names]), 256)
    return slates.select("impression_id", "product_id", F.row_number().over(order).alias("rank"), complete.alias("complete"), digest.alias("bundle_hash"))


# ---------------------------------------------------------------- labels, values and metrics


def build_labels(rows: DataFrame) -> DataFrame:
    """ctr, cvr and ctcvr labels with masks and graded relevance; facts that contradict each other give an error."""
    clicked, bought = F.col("attributed_click") == 1, F.col("attributed_purchase") == 1
    error = F.when(bought & ~clicked, "purchase_without_click").when((F.col("attributed_action") == "purchase") != bought, "action_mismatch").when(F.col("attributed_value") < 0, "negative_value")
    graded = F.when(bought, 4 + F.log1p(F.coalesce("attributed_value", F.lit(0.0)))).otherwise(relevance(F.col("attributed_action")) + 1.0)
    return rows.select(
        "observation_id", clicked.cast("int").alias("ctr"), bought.cast("int").alias("cvr"), bought.cast("int").alias("ctcvr"), clicked.cast("int").alias("cvr_mask"),
        (bought & F.col("attributed_value").isNotNull()).cast("int").alias("value_mask"), F.coalesce("attributed_value", F.lit(0.0)).alias("value"), F.round(graded, 6).alias("relevance"), error.alias("error"),
    )


def group_percentile(values: DataFrame, q: float, accuracy: int = 10_000) -> DataFrame:
    """(bucket, n, clip): rows with a value and the exact q-quantile of each bucket of values(bucket, value), linear between ranks.

    A sketch of bounded size brackets the rank; only distinct values inside the bracket, some 4 / accuracy of a bucket,
    are put in order, so no task or buffer holds a bucket. What lies before is counted; a neighbour on either side covers rounding.
    """
    margin = 2 / accuracy
    ends = F.percentile_approx("value", F.array(F.lit(max(0.0, q - margin)), F.lit(min(1.0, q + margin))), F.lit(accuracy))
    bounds = values.groupBy("bucket").agg(ends.alias("ends")).select("bucket", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))
    placed = _join_buckets(_histogram(values), bounds, "value")
    low, high = F.col("value") < F.col("low"), F.col("value") > F.col("high")
    counts = placed.groupBy("bucket").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(low, F.col("k"))), F.lit(0)).alias("below"), F.max(F.when(low, F.col("value"))).alias("previous"), F.min(F.when(high, F.col("value"))).alias("next"))
    upto = F.sum("k").over(Window.partitionBy("bucket").orderBy("value"))
    ranked = placed.where(~low & ~high).select("bucket", "value", "k", upto.alias("upto")).join(counts, "bucket").withColumn("end", F.col("below") + F.col("upto"))
    rank = q * (F.col("n") - 1)
    at = lambda i: F.max(F.when((i >= F.col("end") - F.col("k")) & (i < F.col("end")), F.col("value")))
    picked = ranked.groupBy("bucket").agg(*[F.first(c).alias(c) for c in ("n", "previous", "next")], F.first(rank).alias("rank"), at(F.floor(rank)).alias("one"), at(F.ceil(rank)).alias("two"))
    one, two = F.coalesce("one", "previous"), F.coalesce("two", "next")
    return picked.select("bucket", "n", (one + (two - one) * (F.col("rank") - F.floor("rank"))).alias("clip"))


#: Tasks that the rows of one bucket are spread over where they meet its statistics.
SALTS = 64


def _join_buckets(rows: DataFrame, stats: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """rows with the statistics of their bucket. Buckets are few and one of them may hold all rows, so a bucket's rows are
    dealt out by the hash of a column, and its statistics stand in every part."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["bucket", "__salt"], how).drop("__salt")


def _histogram(values: DataFrame) -> DataFrame:
    return values.groupBy("bucket", "value").agg(F.count("*").alias("k"))


def value_stats(values: DataFrame, least: int = 20) -> DataFrame:
    """(bucket, n, clip, mean, std): values clipped at the 99th percentile, then log1p, for each bucket with enough
    rows and for all of them (bucket `*`). Null values don't count. Everything comes from counts of equal values."""
    both = values.where("value is not null").select(F.explode(F.array("bucket", F.lit("*"))).alias("bucket"), F.col("value").cast("double").alias("value"))
    limits = group_percentile(both, 0.99).where((F.col("n") >= least) | (F.col("bucket") == "*"))
    apart = F.log1p(F.least("value", "clip")) - F.log1p("clip")  # from the clip, so that squares keep their digits
    sums = _join_buckets(_histogram(both), limits, "value").groupBy("bucket", "n", "clip").agg(F.sum(F.col("k") * apart).alias("s"), F.sum(F.col("k") * apart * apart).alias("t"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("t") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("bucket", "n", *[F.round(c, 6).alias(name) for c, name in ((F.col("clip"), "clip"), (mean + F.log1p("clip"), "mean"), (std, "std"))])


def transform_values(values: DataFrame, stats: DataFrame) -> DataFrame:
    """z-scores by the bucket's statistics, or by all rows' where the bucket has none."""
    whole = stats.where("bucket = '*'").select(F.struct("clip", "mean", "std").alias("g"))
    own = stats.where("bucket <> '*'").select("bucket", F.struct("clip", "mean", "std").alias("s"))
    s = F.coalesce("s", "g")
    out = _join_buckets(values, own, "row_id", "left").crossJoin(F.broadcast(whole))  # one row on the right
    z = (F.log1p(F.least(F.col("value"), s["clip"])) - s["mean"]) / F.when(s["std"] > 1e-6, s["std"]).otherwise(1.0)
    return out.select("row_id", "bucket", F.round(z, 6).alias("z"))


def business_score(predictions: DataFrame) -> DataFrame:
    """Expected value of a shown row: ctcvr times value; confidence within [0, 1]."""
    ctcvr = F.col("ctr") * F.col("cvr")
    return predictions.select("row_id", F.round(ctcvr * F.col("value"), 6).alias("business_score"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.col("ctr") + 0.3 * ctcvr)), 6).alias("confidence"))


def auc(scored: DataFrame) -> DataFrame:
    """Rank-sum AUC with averaged ties, from counts by score: ranks come from a running sum over distinct scores, first
    within ranges of scores and then over the ranges, so that no task sorts all rows."""
    by = scored.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.count("*").cast("double").alias("n")).withColumn("part", F.floor(F.col("score") * 1000))
    parts = by.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = by.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("inside") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return sums.select(F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"))


def mean_ndcg(scored: DataFrame, group: str) -> DataFrame:
    """Mean NDCG over groups of several rows: linear gains over the whole group, the gains of equal scores averaged; a
    group without any relevance has 0."""
    discount = lambda *order: 1 / F.log2(F.row_number().over(Window.partitionBy(group).orderBy(*order)) + 1.0)
    ranked = scored.select(group, "score", "relevance", discount(F.desc("score")).alias("d"), (F.col("relevance") * discount(F.desc("relevance"))).alias("ideal"))
    tied = ranked.groupBy(group, "score").agg((F.sum("relevance") * F.avg("d")).alias("dcg"), F.sum("ideal").alias("ideal"), F.count("*").alias("n"))
    groups = tied.groupBy(group).agg(F.sum("dcg").alias("dcg"), F.sum("ideal").alias("ideal"), F.sum("n").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.round(F.avg(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)), 6).alias("ndcg"))


def ltr_pairs(rows: DataFrame, group: str, gap: float = 0.5, cap: int = 2048) -> DataFrame:
    """Pairs of a group whose relevance differs by at least `gap`, in order of places, the first `cap` of a group."""
    # how many rows each one is above, and how many pairs stand before its own, without forming a pair
    grade = F.round(F.col("relevance") * 1_000_000).cast("bigint")
    below = F.count("*").over(Window.partitionBy(group).orderBy(grade).rangeBetween(Window.unboundedPreceding, -round(gap * 1_000_000)))
    before = F.coalesce(F.sum("lows").over(Window.partitionBy(group).orderBy("position").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = rows.select(group, "position", "relevance").withColumn("lows", below).where("lows > 0").withColumn("before", before).where(F.col("before") < cap)
    a = counted.select(group, F.col("position").alias("high"), F.col("relevance").alias("rh"))
    b = rows.select(group, F.col("position").alias("low"), F.col("relevance").alias("rl"))
    pairs = a.join(b, group).where(F.col("rh") - F.col("rl") >= gap)
    return pairs.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("high", "low"))).where(F.col("rn") <= cap).select(group, "high", "low")


def masked_losses(rows: DataFrame) -> DataFrame:
    """Log-loss of ctr, of cvr where clicked, and Huber loss of values where known."""
    loss = lambda p, y: -(y * F.log(F.greatest(p, F.lit(1e-7))) + (1 - y) * F.log(F.greatest(1 - p, F.lit(1e-7))))
    apart = F.abs(F.col("value_hat") - F.col("value_z"))
    huber = F.when(apart <= 1, apart * apart / 2).otherwise(apart - 0.5)
    return rows.agg(
        F.round(F.avg(loss(F.col("p_ctr"), F.col("ctr"))), 6).alias("ctr_loss"), F.round(F.avg(F.when(F.col("ctr") == 1, loss(F.col("p_cvr"), F.col("cvr")))), 6).alias("cvr_loss"),
        F.round(F.avg(F.when(F.col("cvr") == 1, huber)), 6).alias("value_loss"),
    )


# ---------------------------------------------------------------- vectors


def vector_topk(queries: DataFrame, items: DataFrame, k: int, threshold: float = -1.0, block: int = 2048) -> DataFrame:
    """The k nearest items of each query by inner product of unit vectors: (query_id, item_id, score, rank).

    Items are cut into blocks; queries meet each block, and only the block's k best of a query leave the task, so the
    shuffle moves queries times blocks times k rows, never all pairs. Both sides are split into blocks by hash. Ids are whole
    numbers or texts.
    """
    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, items)]
    q = queries.select(F.col("id").alias("query_id"), l2_normalize(F.col("vector")).alias("vector")).where("vector is not null").repartition("query_id")
    i = items.select(F.col("id").alias("item_id"), l2_normalize(F.col("vector")).alias("vector")).where("vector is not null")
    n = max(1, -(-items.count() // block))
    q_blocks = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // block)))).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    i_blocks = i.withColumn("b", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
    spread = q_blocks.select("qb").distinct()
    i_blocks = i_blocks.join(F.broadcast(spread.withColumnRenamed("qb", "qb2")))  # query blocks: queries / block rows

    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["query_id", "item_id", "score"])
        scores = np.stack(left["vector"]) @ np.stack(right["vector"]).T
        scores = np.round(scores, 6)
        ids = right["item_id"].to_numpy()
        ids = ids.astype(str) if ids.dtype == object else ids
        out = []
        for row, query in zip(scores, left["query_id"], strict=True):
            top = np.lexsort((ids, -row))[: k + 1]
            top = top[(row[top] >= threshold) & (ids[top] != query)][:k]
            out.append(pd.DataFrame({"query_id": query, "item_id": ids[top], "score": row[top]}))
        return pd.concat(out)

    i_blocks = i_blocks.withColumnRenamed("qb2", "qb")
    parts = q_blocks.groupBy("qb", "b").cogroup(i_blocks.groupBy("qb", "b")).applyInPandas(best, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def assign_clusters(items: DataFrame, centroids: DataFrame, n: int = 1) -> DataFrame:
    """The nearest n centroids of each item by dot product. Centroids are model-sized: their number is checked."""
    if centroids.count() > 10_000:
        raise ValueError("more centroids than may be broadcast")
    # one row of all centroids; an item's scores never leave its task
    model = centroids.agg(F.collect_list(F.struct("cluster", F.col("vector").alias("c"))).alias("model"))
    scores = F.transform("model", lambda m: F.struct((-F.round(dot(F.col("vector"), m["c"]), 6)).alias("score"), m["cluster"].alias("cluster")))
    best = items.select("id", "vector").crossJoin(F.broadcast(model)).select("id", F.slice(F.sort_array(scores), 1, n).alias("best"))
    return best.select("id", F.posexplode("best").alias("place", "b")).select("id", "b.cluster", (-F.col("b.score")).alias("score"), (F.col("place") + 1).alias("rank"))


#: Numbers of vectors that mmr_slate ranks at a time.
MMR_NUMBERS = 1 << 21


def mmr_slate(rows: DataFrame, keep: float = 0.8, k: int = 10) -> DataFrame:
    """Greedy re-ranking of each slate(slate_id, product_id, score, vector): keep x score (min-max) less (1 - keep) x the
    highest cosine to a chosen row. Rows without a vector have no penalty. Slates are at most a few hundred rows.
    Slates lie together and in order in their partitions, and a batch's slates of one length are ranked at once."""

    def chosen(score: np.ndarray, unit: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Places by rank of slates (a row each) of one length."""
        slates, n = score.shape
        low, every = np.fmin.reduce(score, axis=1, keepdims=True), np.arange(slates)
        spread = np.fmax.reduce(score, axis=1, keepdims=True) - low
        base = np.where(spread > 0, (score - low) / np.where(spread > 0, spread, 1), score * 0 + 1)
        left, order, worst = np.ones((slates, n), bool), [], np.zeros((slates, n))
        for step in range(min(k, n)):
            i = np.where(left, np.round(keep * base - (1 - keep) * worst, 9), -np.inf).argmax(axis=1)
            left[every, i] = False
            order.append(i)
            cosine = np.where(known, np.einsum("snd,sd->sn", unit, unit[every, i]), 0)
            worst = np.where(known[every, i][:, None], np.maximum(worst, cosine) if step else cosine, worst)
        return np.stack(order, axis=1)

    def ranked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The rows of whole slates."""
        ids, products, vectors = (table[c].combine_chunks() for c in ("slate_id", "product_id", "vector"))
        score = table["score"].to_numpy().astype(float)
        known = vectors.is_valid().to_numpy(zero_copy_only=False)
        length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        at, flat = np.cumsum(length) - length, vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
        firsts = np.flatnonzero(np.r_[True, changes(ids)])
        sizes = np.diff(np.r_[firsts, len(ids)])
        widths = np.maximum.reduceat(length, firsts)
        if (known & (length != np.repeat(widths, sizes))).any():
            raise ValueError("the vectors of a slate have one length")
        for n, width in {(int(n), int(w)) for n, w in zip(sizes, widths, strict=True)}:
            same = firsts[(sizes == n) & (widths == width)]
            block = max(1, MMR_NUMBERS // (n * max(1, width)))
            for some in (same[i : i + block] for i in range(0, len(same), block)):
                rows = some[:, None] + np.arange(n)
                unit = np.zeros((*rows.shape, width))
                unit[known[rows]] = flat[at[rows][known[rows]][:, None] + np.arange(width)]
                unit /= np.maximum(np.linalg.norm(unit, axis=2, keepdims=True), 1e-12)
                order = chosen(score[rows], unit, known[rows])
                taken = pa.array((some[:, None] + order).ravel())
                rank = np.tile(np.arange(1, order.shape[1] + 1), len(some))
                yield pa.RecordBatch.from_arrays([ids.take(taken), products.take(taken), pa.array(rank)], ["slate_id", "product_id", "rank"])

    def by_slates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "slate_id"):
            yield from ranked(table)

    ship_package(rows.sparkSession)
    score = F.col("score").cast("double")
    own = rows.select(F.col("slate_id").cast("string").alias("slate_id"), F.col("product_id").cast("string").alias("product_id"), F.when(~F.isnan(score), score).alias("score"), F.col("vector").cast("array<double>").alias("vector"))
    together = own.repartition("slate_id").sortWithinPartitions("slate_id", F.desc_nulls_last("score"), F.asc_nulls_last("product_id"))
    return together.mapInArrow(by_slates, "slate_id string, product_id string, rank long")


# ---------------------------------------------------------------- quality


def reconcile(published: DataFrame, lake: DataFrame, dlq: DataFrame) -> DataFrame:
    """One row: distinct published ids, lake duplicates, ids missing from lake and dead letters, ids nobody published."""
    ids = lambda df: df.select("event_id").distinct()
    stored = ids(lake).union(ids(dlq)).distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name))
    repeated = lake.groupBy("event_id").count().where("count > 1")
    parts = [one(ids(published), "published"), one(repeated, "duplicates"), one(ids(published).exceptAll(stored), "missing"), one(stored.exceptAll(ids(published)), "unexpected")]
    out = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    return out.withColumn("ok", F.expr("duplicates = 0 and missing = 0 and unexpected = 0"))


def validate_products(products: DataFrame) -> DataFrame:
    """Products with issues, joined by commas in a fixed order."""
    issues = F.array(
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "no_title"), F.when(F.coalesce("price", F.lit(-1.0)) <= 0, "bad_price"),
        F.when(~F.col("rating").between(0, 5), "bad_rating"), F.when(~F.col("in_stock"), "out_of_stock"),
    )
    found = F.filter(issues, lambda x: x.isNotNull())
    return products.where(F.size(found) > 0).select("product_id", F.array_join(found, ",").alias("issues"))


def price_summary(products: DataFrame) -> DataFrame:
    """Per category: rows, price range, mean, and the upper median (the element at half the count)."""
    w = Window.partitionBy("category").orderBy("price", "product_id")
    placed = products.select("category", "price", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("category")).alias("n"))
    return placed.groupBy("category").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.round(F.avg("price"), 6).alias("mean"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("price"))).alias("median"))


def latency_summary(log: DataFrame, group: str) -> DataFrame:
    """Per group: rows, success rate, mean and nearest-rank percentiles (rank rounded half to even)."""
    w = Window.partitionBy(group).orderBy("latency")
    n = F.count("*").over(Window.partitionBy(group))
    placed = log.select(group, "latency", "ok", (F.row_number().over(w) - 1).alias("i"), n.alias("n"))
    pick = lambda q: F.max(F.when(F.col("i") == F.bround(q * (F.col("n") - 1)), F.col("latency")))
    return placed.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success"), F.round(F.avg("latency"), 6).alias("mean"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.max("latency").alias("most"))


def shadow_gate(daily: DataFrame, today: str, days: int = 7) -> DataFrame:
    """One row: does an unbroken run of at least `days` passing days end today? Repeated dates fail."""
    per_day = daily.groupBy("day").agg(F.count("*").alias("n"), F.min("passed").alias("passed"))
    good = per_day.where("passed").select("day", F.date_sub("day", F.row_number().over(Window.orderBy("day"))).alias("island"))  # a row a day
    runs = good.groupBy("island").agg(F.count("*").alias("run"), F.max("day").alias("last"))
    current = runs.where(F.col("last") == F.lit(today).cast("date")).agg(F.coalesce(F.max("run"), F.lit(0)).alias("run"))
    repeated = per_day.agg(F.count_if(F.col("n") > 1).alias("repeated"))
    return current.crossJoin(repeated).select("run", "repeated", ((F.col("run") >= days) & (F.col("repeated") == 0)).alias("ok"))


def weighted_text_consensus(regions: DataFrame) -> DataFrame:
    """Per group the normalised text with the highest summed confidence (ties: the larger text) and its best raw form."""
    by_text = regions.groupBy("group_id", "norm").agg(F.round(F.sum("confidence"), 6).alias("weight"), F.max_by("raw", F.struct("confidence", "raw")).alias("raw"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    return by_text.groupBy("group_id").agg(F.max(F.struct("weight", "norm", "raw", "first_seen", "last_seen")).alias("b")).select("group_id", "b.norm", "b.weight", "b.raw", "b.first_seen", "b.last_seen")


def coverage_metrics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.round(F.avg(F.col("value_mask").cast("double")), 6).alias("value_coverage"), F.round(F.avg((F.col("length") > 0).cast("double")), 6).alias("sequence_coverage"))


def lag_report(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """Lag of each partition; an uncommitted one is fine only if the topic's partition is empty."""
    both = committed.join(ends, "partition", "full_outer")
    reason = F.when(F.col("end").isNull(), "unknown_partition").when(F.col("offset").isNull() & (F.col("end") > 0), "uncommitted").when(F.col("offset") < F.col("end"), "behind").otherwise("ok")
    return both.select("partition", (F.col("end") - F.coalesce("offset", F.lit(0))).alias("lag"), reason.alias("reason"))
