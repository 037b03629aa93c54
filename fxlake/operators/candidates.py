"""Candidate generation: popularity, trending, item-to-item scores, vectors, merging and slates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POPULARITY = {"view": 1.0, "click": 2.0, "add_to_cart": 3.0, "purchase": 5.0, "favorite": 2.5, "share": 1.5}
TRENDING = {"view": 1.0, "click": 3.0, "add_to_cart": 5.0, "purchase": 10.0, "favorite": 4.0, "share": 6.0}
SEEDS = {"view": 1.0, "click": 2.0, "add_to_cart": 3.0, "purchase": 5.0}


def weight(weights: dict[str, float], default: float = 0.0) -> Column:
    return reduce(lambda tail, x: F.when(F.col("action") == x[0], F.lit(x[1])).otherwise(tail), weights.items(), F.lit(default))


def _normalized_topk(scores: DataFrame, k: int) -> DataFrame:
    most = scores.agg(F.max("raw").alias("most"))
    out = scores.crossJoin(F.broadcast(most)).where("most > 0")  # one row on the right
    return out.select("product_id", F.round(F.col("raw") / F.col("most"), 6).alias("score")).orderBy(F.desc("score"), "product_id").limit(k)


def item_popularity(events: DataFrame, k: int = 100) -> DataFrame:
    return _normalized_topk(events.groupBy("product_id").agg(F.sum(weight(POPULARITY, 1.0)).alias("raw")), k)


def trending_scores(events: DataFrame, now: float, hours: int = 24, decay: float = 0.95, k: int = 100) -> DataFrame:
    recent = events.where((F.col("event_time") > now - 3600 * hours) & (F.col("event_time") <= now))
    aged = weight(TRENDING, 1.0) * F.pow(F.lit(decay), (F.lit(now) - F.col("event_time")) / 3600)
    return _normalized_topk(recent.groupBy("product_id").agg(F.sum(aged).alias("raw")), k)


def swing_index(events: DataFrame, alpha: float = 5.0, per_user: int = 100, users_per_item: int = 500, common: int = 2, k: int = 100) -> DataFrame:
    """Item-to-item scores: each pair of users with at least `common` items in common adds 1 / (alpha + common) to
    every ordered pair of those items. Both fan-outs are capped before the self-join (the method's own limits)."""
    positive = events.where(F.col("action").isin(*SEEDS)).groupBy("user_id", "product_id").agg(F.max(F.struct("event_time", "event_id")).alias("last"))
    recent = Window.partitionBy("user_id").orderBy(F.desc("last"), "product_id")
    kept = positive.withColumn("rn", F.row_number().over(recent)).where(F.col("rn") <= per_user)
    first = Window.partitionBy("product_id").orderBy("user_id")
    kept = kept.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= users_per_item).select("user_id", "product_id")
    from fxlake.operators.features import dense_ids

    # whole numbers from here on; each pair of users and of items once, mirrored after the sums
    users, items = dense_ids(kept, "user_id", "u"), dense_ids(kept, "product_id", "i")
    numbered = kept.join(users, "user_id").join(items, "product_id").select(F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"))
    pairs = numbered.join(numbered.select(F.col("u").alias("v"), "i"), "i").where("u < v").groupBy("u", "v").agg(F.collect_list("i").alias("items")).where(F.size("items") >= common)
    each = pairs.select(F.posexplode("items").alias("place", "a"), "items", (1.0 / (alpha + F.size("items"))).alias("w"))
    once = each.select("a", F.explode(F.slice("items", F.col("place") + 2, F.size("items"))).alias("b"), "w")
    sums = once.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("raw"))
    scores = sums.unionByName(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "raw"))
    for column, name in (("a", "item_id"), ("b", "neighbor_id")):
        scores = scores.join(items.select(F.col("i").alias(column), F.col("product_id").alias(name)), column)
    scores = scores.select("item_id", "neighbor_id", "raw")
    best = Window.partitionBy("item_id").orderBy(F.desc(F.round("raw", 9)), "neighbor_id")
    top = scores.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)
    most = F.max("raw").over(Window.partitionBy("item_id"))
    return top.select("item_id", "neighbor_id", F.round(F.col("raw") / most, 6).alias("score"))


def swing_candidates(index: DataFrame, events: DataFrame, now: float, seeds: int = 20, k: int = 40) -> DataFrame:
    """Neighbours of each user's last products, weighted by action and age; products already positive are left out."""
    positive = events.where(F.col("action").isin(*SEEDS) & (F.col("event_time") <= now)).groupBy("user_id", "product_id").agg(F.max("event_time").alias("last"), F.max(weight(SEEDS)).alias("w"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("last"), "product_id")
    chosen = positive.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= seeds)
    aged = F.col("w") / (1 + F.greatest(F.lit(now) - F.col("last"), F.lit(0.0)) / 86400 / 30)
    scored = chosen.join(index, chosen["product_id"] == index["item_id"]).groupBy("user_id", "neighbor_id").agg(F.sum(aged * F.col("score")).alias("raw"))
    fresh = scored.withColumnRenamed("neighbor_id", "product_id").join(positive.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
    best = Window.partitionBy("user_id").orderBy(F.desc(F.round("raw", 6)), "product_id")
    return fresh.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("user_id", "product_id", F.round("raw", 6).alias("score"), "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The unit vector, or null for a norm that is zero or not finite."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: x.cast("double") / norm))


def score_to_similarity(raw: Column, metric: str) -> Column:
    value = (raw + 1) / 2 if metric == "ip" else 1 - raw / 4
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def merge_candidates(*sources: tuple[str, DataFrame]) -> DataFrame:
    """One row for each user and product: the best score of each source, and the source names in order of arrival."""
    names = [name for name, _ in sources]
    parts = [df.select("user_id", "product_id", F.lit(i).alias("i"), F.lit(name).alias("source"), F.col("score")) for i, (name, df) in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts)
    out = rows.groupBy("user_id", "product_id").agg(
        *[F.max(F.when(F.col("source") == n, F.col("score"))).alias(f"{n}_score") for n in names],
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("i", "source"))), lambda x: x["source"]), "+").alias("sources"),
        F.countDistinct("source").alias("n_sources"),
    )
    return out


def source_counts(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.explode(F.split("sources", r"\+")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def exclude_seen(candidates: DataFrame, interactions: DataFrame) -> DataFrame:
    return candidates.join(interactions.select("user_id", "product_id").distinct(), ["user_id", "product_id"], "left_anti")


def rank_topk(candidates: DataFrame, k: int, score: str = "combined_score", by: str = "user_id") -> DataFrame:
    best = Window.partitionBy(by).orderBy(F.desc(score), "product_id")
    return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def diversity_filter(candidates: DataFrame, cap: int = 3, least: int = 10, by: str = "user_id") -> DataFrame:
    """At most `cap` of each category for each user, in rank order, and a quota of products without category.

    The quota is 3 plus, for each round up to the cap that finds a category with that many products, what the round
    leaves of 3. Lists of at most `least` are left as they are.
    """
    listed = candidates.withColumn("__n", F.count("*").over(Window.partitionBy(by)))
    listed = listed.withColumn("__c", F.row_number().over(Window.partitionBy(by, "category").orderBy("rank")))
    own = Window.partitionBy(by)
    quota = F.lit(3)
    for r in range(1, cap + 1):
        n = F.sum(F.when(F.col("category").isNotNull() & (F.col("__c") == r), 1).otherwise(0)).over(own)
        quota = quota + F.when(n > 0, F.greatest(F.lit(0), 3 - n)).otherwise(0)
    listed = listed.withColumn("__q", quota)
    keep = (F.col("__n") <= least) | (F.col("__c") <= F.when(F.col("category").isNull(), F.col("__q")).otherwise(F.lit(cap)))
    return listed.where(keep).drop("__n", "__c", "__q")


def serving_pools(products: DataFrame, trending: DataFrame, now: float, top: int = 300, per_category: int = 150, clusters: DataFrame | None = None, per_cluster: int = 150) -> DataFrame:
    """pool, product_id, rank, score: products by trend, rating, reviews and freshness. The pools are `global`, one for each
    category ('unknown' without one) and, with `clusters` (product_id, cluster), one for each content cluster, each
    normalised by its own highest score."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.coalesce("created_at", F.lit(now))) / 86400)
    raw = F.coalesce("score", F.lit(0.0)) + 0.6 * F.coalesce("rating", F.lit(0.0)) / 5 + 0.2 * F.log1p(F.coalesce("num_reviews", F.lit(0))) / 5 + 0.2 / (1 + age / 30)
    scored = products.join(trending, "product_id", "left").select("product_id", F.coalesce("category", F.lit("unknown")).alias("category"), F.round(raw, 6).alias("raw"))
    order = F.desc("raw"), "product_id"
    whole = scored.orderBy(*order).limit(top).select(F.lit("global").alias("pool"), "product_id", "raw")
    pools = whole.withColumn("rank", F.row_number().over(Window.partitionBy("pool").orderBy(*order)))  # `top` rows
    each = [(scored.select(F.concat(F.lit("category:"), "category").alias("pool"), "product_id", "raw"), per_category)]
    if clusters is not None:
        own = clusters.where("cluster is not null").select("product_id", F.concat(F.lit("cluster:"), F.col("cluster").cast("string")).alias("pool"))
        each.append((scored.join(own, "product_id").select("pool", "product_id", "raw"), per_cluster))
    for rows, most in each:
        pools = pools.unionByName(rows.withColumn("rank", F.row_number().over(Window.partitionBy("pool").orderBy(*order))).where(F.col("rank") <= most))
    highest = F.max("raw").over(Window.partitionBy("pool"))
    return pools.select("pool", "product_id", "rank", F.round(F.col("raw") / F.when(highest == 0, 1.0).otherwise(highest), 6).alias("score"))
