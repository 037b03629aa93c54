"""Candidates for all users at once: pools that each user prefers, sources with their caps, merging, and a fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fxlake.operators.candidates import diversity_filter, rank_topk

#: Most candidates of each source, the score that a source's candidates have, and the weights of scores.
CAPS = {"cf": 40, "sasrec": 40, "swing_itemcf": 40, "content": 20, "trending_pool": 30, "category_pool": 30, "cluster_pool": 30, "new_item": 10, "random": 10}
SCORE_OF = {"cf": "collaborative", "sasrec": "collaborative", "swing_itemcf": "collaborative", "content": "content", "trending_pool": "popularity", "category_pool": "popularity", "cluster_pool": "popularity", "new_item": "collaborative"}
WEIGHTS = {"collaborative": 0.4, "content": 0.3, "popularity": 0.3}
POOL_SOURCES = ("trending_pool", "category_pool", "cluster_pool")
#: Random candidates of a user without any other.
COLD_RANDOM = 50
#: Pools are broadcast below this many bytes, and joined by a shuffle above.
POOL_BYTES = 64 << 20


def first_distinct(values: Column, n: int) -> Column:
    """The first n different values of an array that are neither null nor blank."""
    return F.slice(F.array_distinct(F.filter(values, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")), 1, n)


def preferred_pools(users: DataFrame, positives: DataFrame, clusters: DataFrame, categories: int = 2, n_clusters: int = 2) -> DataFrame:
    """user_id, pool, source, share: up to two category and two cluster pools of each user; a pool gives cap / share.

    users have user_id and arrays of category names, each in its order: context_categories, speech_categories,
    preferred_categories (this order counts), and content_clusters (of what the user is looking at). Free places for clusters
    go to those of the newest positive events (user_id, product_id, event_time, event_id); events of products without a
    cluster are passed over, and two events of one cluster are one pool.
    """
    empty = F.array().cast("array<string>")
    names = reduce(F.concat, [F.coalesce(c, empty) for c in ("context_categories", "speech_categories", "preferred_categories")])
    shown = users.select("user_id", first_distinct(names, categories).alias("c"), F.slice(F.coalesce(F.col("content_clusters").cast("array<string>"), empty), 1, n_clusters).alias("content"))
    known = positives.join(clusters.where("cluster is not null").select("product_id", F.col("cluster").cast("string").alias("cluster")), "product_id")
    newest = Window.partitionBy("user_id").orderBy(F.desc("event_time"), F.desc("event_id"))
    last = known.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n_clusters)
    recent = last.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "cluster"))), lambda x: x["cluster"]).alias("recent"))
    both = shown.join(recent, "user_id", "left")
    both = both.withColumn("k", F.array_distinct(F.slice(F.concat("content", F.coalesce("recent", empty)), 1, n_clusters)))

    def pools(column: str, prefix: str, source: str) -> DataFrame:
        each = both.select("user_id", F.size(column).alias("share"), F.posexplode(column).alias("place", "name"))
        return each.select("user_id", F.concat(F.lit(f"{prefix}:"), "name").alias("pool"), F.lit(source).alias("source"), "place", "share")

    return pools("c", "category", "category_pool").unionByName(pools("k", "cluster", "cluster_pool"))


def _as_lists(pools: DataFrame) -> DataFrame:
    """A row for each pool with its products in order; pools have a few hundred products by their making."""
    return pools.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("rank", "product_id", "score"))).alias("listed"))


def probe_pools(wanted: DataFrame, pools: DataFrame, seen: DataFrame, caps: dict[str, int]) -> DataFrame:
    """user_id, product_id, score, source, order: of each wanted pool (user_id, pool, source, place, share) the first products
    that the user hasn't seen, max(1, cap / share) of them. A user's list of seen products is cut to those in the pool."""
    lists = _as_lists(pools)
    size = lists.agg(F.sum(F.length(F.to_json("listed")))).first()[0] or 0
    lists = F.broadcast(lists) if size <= POOL_BYTES else lists
    met = seen.join(pools.select("pool", "product_id"), "product_id").join(wanted.select("user_id", "pool"), ["user_id", "pool"])
    met = met.groupBy("user_id", "pool").agg(F.collect_set("product_id").alias("met"))
    rows = wanted.join(lists, "pool").join(met, ["user_id", "pool"], "left")
    fresh = F.filter("listed", lambda x: F.coalesce(~F.array_contains("met", x["product_id"]), F.lit(True)))
    cap = reduce(lambda tail, s: F.when(F.col("source") == s, F.lit(caps[s])).otherwise(tail), POOL_SOURCES, F.lit(0))
    most = F.when(cap <= 0, 0).otherwise(F.greatest(F.lit(1), F.floor(cap / F.greatest("share", F.lit(1))))).cast("int")
    out = rows.select("user_id", "source", "place", F.posexplode(F.slice(fresh, F.lit(1), most)).alias("at", "x"))
    return out.select("user_id", "source", F.col("x.product_id").alias("product_id"), F.col("x.score").alias("score"), (F.col("place") * 100000 + F.col("at")).alias("order"))


def generate_candidates(
    users: DataFrame, sources: dict[str, DataFrame], preferred: DataFrame, pools: DataFrame, new_items: DataFrame, seen: DataFrame, products: DataFrame,
    caps: dict[str, int] | None = None, target: int = 100, most: int = 500, seed: int = 7, diversity: int | None = 3,
) -> DataFrame:
    """The candidates of all users: product_id, collaborative_score, content_score, popularity_score, combined_score, sources
    (joined by + in the order of CAPS) and rank.

    `sources` are frames (user_id, product_id, score) of cf, sasrec, swing_itemcf and content; `pools` and `preferred` as
    `serving_pools` and `preferred_pools` give them; new_items has product_id and score; `seen` has user_id and product_id;
    `products` has product_id and category. Each source gives its cap at most, without what the user has seen: content and
    new items are cut first and filtered then, the others the other way round. Of each score the highest counts. Users with
    fewer than `target` candidates get random products (COLD_RANDOM for those without any).
    """
    caps = CAPS | (caps or {})
    pair = ["user_id", "product_id"]
    everyone, seen = users.select("user_id").distinct(), seen.select(*pair).where("product_id is not null").distinct()

    def top(rows: DataFrame, n: int) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy(F.desc("score"), "product_id")
        return rows.withColumn("order", F.row_number().over(w)).where(F.col("order") <= n)

    found = []
    for name in ("cf", "sasrec", "swing_itemcf", "content"):
        if name in sources and caps[name] > 0:
            rows = sources[name].select(*pair, "score").join(everyone, "user_id")
            rows = top(rows, caps[name]).join(seen, pair, "left_anti") if name == "content" else top(rows.join(seen, pair, "left_anti"), caps[name])
            found.append(rows.select(*pair, F.lit(name).alias("source"), "score"))
    everywhere = everyone.select("user_id", F.lit("global").alias("pool"), F.lit("trending_pool").alias("source"), F.lit(0).alias("place"), F.lit(1).alias("share"))
    wanted = everywhere.unionByName(preferred.join(everyone, "user_id").select("user_id", "pool", "source", "place", "share"))
    found.append(probe_pools(wanted, pools, seen, caps).select(*pair, "source", "score"))
    if caps["new_item"] > 0:
        fresh = new_items.orderBy(F.desc("score"), "product_id").limit(caps["new_item"]).agg(F.collect_list(F.struct("product_id", "score")).alias("x"))  # the cap's number
        each = everyone.crossJoin(F.broadcast(fresh)).select("user_id", F.explode("x").alias("x")).select("user_id", "x.*")  # one row on the right
        found.append(each.join(seen, pair, "left_anti").select(*pair, F.lit("new_item").alias("source"), "score"))
    rows = reduce(DataFrame.unionByName, found)

    order = F.array_position(F.array(*map(F.lit, CAPS)), F.col("source"))
    kind = reduce(lambda tail, s: F.when(F.col("source") == s, F.lit(SCORE_OF[s])).otherwise(tail), SCORE_OF, F.lit(None).cast("string"))
    named = lambda c: F.array_join(F.transform(F.sort_array(F.collect_set(F.struct(order.alias("o"), F.col("source").alias("s")))), lambda x: x["s"]), "+").alias(c)
    merged = rows.withColumn("kind", kind).groupBy(pair).agg(*[F.max(F.when(F.col("kind") == k, F.col("score"))).alias(f"{k}_score") for k in WEIGHTS], named("sources"))
    merged = merged.unionByName(random_candidates(everyone, merged, seen, products, caps["random"], target, seed), allowMissingColumns=True)
    merged = merged.withColumn("combined_score", reduce(Column.__add__, [F.coalesce(f"{k}_score", F.lit(0.0)) * w for k, w in WEIGHTS.items()]))
    if diversity is not None:
        listed = rank_topk(merged.join(products.select("product_id", "category").dropDuplicates(["product_id"]), "product_id", "left"), 1 << 30)
        merged = diversity_filter(listed, diversity).drop("category", "rank")
    return rank_topk(merged, most)


def random_candidates(users: DataFrame, candidates: DataFrame, seen: DataFrame, products: DataFrame, n: int, target: int, seed: int) -> DataFrame:
    """Random products for users with fewer than `target` candidates: min(target - candidates, n), and for users without any
    min(target, n, COLD_RANDOM). Seen products and candidates among them are dropped and not replaced."""
    pair = ["user_id", "product_id"]
    if n <= 0:
        return candidates.select(*pair, "sources").limit(0)
    counts = candidates.groupBy("user_id").agg(F.count("*").alias("have"))
    thin = users.join(counts, "user_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < target)
    need = F.least(F.lit(target) - F.col("have"), F.lit(n), F.when(F.col("have") == 0, COLD_RANDOM).otherwise(n))
    drawn = draw(thin.select("user_id", need.cast("int").alias("need")), products, seed)
    return drawn.join(seen, pair, "left_anti").join(candidates.select(*pair), pair, "left_anti").select(*pair, F.lit("random").alias("sources"))


def draw(users: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """user_id, product_id, rank: `need` different products of the whole catalog for each user, by hash, the same on every run.

    Products are numbered, and a user's places are start, start + step, ... modulo their number, with a step that has no
    common divisor with it: so no place comes twice before all have come, and no user meets the catalog.
    """
    from fxlake.operators.features import dense_ids

    numbered = dense_ids(items, "product_id", "place")
    n = numbered.count()
    if not n:
        return users.select("user_id", F.lit(None).cast("string").alias("product_id"), F.lit(0).alias("rank")).where("false")
    factors = [p for p in range(2, int(n**0.5) + 1) if n % p == 0]
    primes = [p for p in {*factors, *(n // p for p in factors), n} if p > 1 and all(p % q for q in range(2, int(p**0.5) + 1))]
    number = lambda salt: F.pmod(F.xxhash64("user_id", F.lit(seed), F.lit(salt)), F.lit(n))
    tries = F.transform(F.sequence(F.lit(0), F.lit(4 * max(1, n.bit_length()))), lambda i: F.pmod(F.col("step") + i, F.lit(n)))
    coprime = F.filter(tries, lambda x: reduce(Column.__and__, [x % p != 0 for p in primes], x > 0)) if n > 1 else F.array(F.lit(0).cast("long"))
    own = users.select("user_id", F.least("need", F.lit(n)).alias("need"), number(1).alias("start"), number(2).alias("step"))
    own = own.where("need > 0").withColumn("step", F.coalesce(F.get(coprime, F.lit(0)), F.lit(1).cast("long")))
    places = own.select("user_id", F.posexplode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("need").cast("long")), lambda i: F.pmod(F.col("start") + i * F.col("step"), F.lit(n)) + 1)).alias("rank", "place"))
    return places.join(numbered, "place").select("user_id", "product_id", (F.col("rank") + 1).alias("rank"))
