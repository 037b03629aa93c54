"""Training inputs: next-item samples, cold start, negatives, history vectors, two-tower tables, pending work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fxlake.functions.scalars import stable_hash_bucket
from fxlake.operators.candidates import dot, l2_normalize
from fxlake.operators.windows import POSITIVE

#: Scale of an action's mean vector.
ACTION_SCALE = {"click": 1.0, "add_to_cart": 1.25, "purchase": 1.75}


def dense_ids(df: DataFrame, key: str, name: str, parts: int = 256) -> DataFrame:
    """(key, name): numbers from 1 in the order of keys. Ranges of keys are numbered apart and then moved by the sizes of
    the ranges before, so that no task sorts all keys. The ranges' bounds are the `parts` keys of the smallest hashes, so
    they are the same whenever a lost task runs again, and spread as the keys do, also where keys share a prefix."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    bounds = keys.orderBy(F.xxhash64(key), key).limit(parts).agg(F.sort_array(F.collect_list(key)).alias("__bounds"))
    placed = keys.crossJoin(F.broadcast(bounds))  # one row of at most `parts` keys
    placed = placed.select(key, F.size(F.filter("__bounds", lambda x: x <= F.col(key))).alias("__p"))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("n"))
    starts = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    return placed.withColumn("i", inside).join(F.broadcast(starts), "__p").select(key, (F.col("start") + F.col("i")).alias(name))


def next_item_samples(sequences: DataFrame, ids: DataFrame, most: int = 20) -> DataFrame:
    """Per user: the last items as numbers, inputs without the last and labels without the first, zero-padded right."""
    items = sequences.select("user_id", F.posexplode("sequence").alias("i", "e")).select("user_id", "i", F.col("e.product_id").alias("product_id")).join(ids, "product_id")
    numbered = items.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "item"))), lambda x: x["item"]).alias("s")).where(F.size("s") >= 2)
    cut = F.when(F.size("s") > most + 1, F.slice("s", -(most + 1), most + 1)).otherwise(F.col("s"))
    numbered = numbered.select("user_id", cut.alias("s"))
    n = F.size("s") - 1
    padded = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), most - n))
    return numbered.select("user_id", padded(F.slice("s", F.lit(1), n)).alias("inputs"), padded(F.slice("s", F.lit(2), n)).alias("labels"))


def cold_start_eligible(products: DataFrame, trained: DataFrame, counts: DataFrame, now: float, days: int = 30, most_events: int = 5, k: int = 500) -> DataFrame:
    """Untrained products in stock, young and with few interactions; the newest k."""
    fresh = products.where("in_stock").where(F.col("created_at") >= now - 86400 * days).join(trained.select("product_id"), "product_id", "left_anti").join(counts, "product_id", "left")
    return fresh.where(F.coalesce("n", F.lit(0)) <= most_events).orderBy(F.desc("created_at"), "product_id").limit(k).select("product_id", "created_at", F.coalesce("n", F.lit(0)).alias("n"))


def new_item_candidates(eligible: DataFrame, now: float, days: int = 30, confidence: float = 0.5, k: int = 30) -> DataFrame:
    fresh = F.greatest(F.lit(0.0), 1 - (F.lit(now) - F.col("created_at")) / (86400 * days))
    return eligible.select("product_id", F.round(0.5 * fresh + 0.5 * confidence, 6).alias("score")).orderBy(F.desc("score"), "product_id").limit(k)


def random_fallback(users: DataFrame, items: DataFrame, n: int, seed: int) -> DataFrame:
    """n different items for each user (all, if there are fewer), drawn from the whole catalog by hash, the same on every run."""
    from fxlake.operators.generation import draw

    return draw(users.select("user_id", F.lit(n).alias("need")), items.select("product_id"), seed)


#: Weight of a negative by source.
NEGATIVE_WEIGHTS = {"impression": 0.25, "rejected": 0.15, "ann_hard": 0.35, "random": 1.0}


def hard_quota(total: int, epoch: int = 0, epochs: int = 1, start: float = 0.1, end: float = 0.5, cap: float = 0.2) -> int:
    """How many of a user's negatives are hard ones: a share that rises from epoch to epoch, up to a cap."""
    share = end if epochs <= 1 else start + (end - start) * min(epoch / (epochs - 1), 1.0)
    return min(total, int(total * min(share, max(0.0, min(cap, 1.0)))))


def user_vectors(positives: DataFrame, items: DataFrame) -> DataFrame:
    """(id, vector): the mean of the unit vectors of each user's positives. items: id, vector."""
    unit = items.select(F.col("id").alias("product_id"), F.posexplode(l2_normalize(F.col("vector"))).alias("d", "x"))
    means = positives.select("user_id", "product_id").distinct().join(unit, "product_id").groupBy("user_id", "d").agg(F.avg("x").alias("x"))
    return means.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("vector"))


def sample_negatives(
    positives: DataFrame, external: DataFrame, quotas: dict[str, int], seed: int, users: DataFrame | None = None, products: DataFrame | None = None, items: DataFrame | None = None,
    vectors: DataFrame | None = None, total: int = 0, hard: int = 0,
) -> DataFrame:
    """Negatives of each user: user_id, product_id, source, weight. Sources of `external` come first, in the order of quotas,
    each up to its quota in hash order, then `hard` of the products nearest to the user's vector, then random products of
    the catalog up to `total`; never a positive, none twice. A product that a source leaves may be taken by a later one.

    The nearest are the first 5 x hard products by inner product of unit vectors (items and vectors: id, vector); a user
    without a vector has none. Where a catalog (products) has too few for `total`, rows without product and weight fill up.
    `users` are those who get hard and random ones. All that may be taken is gathered first, so each user is passed once.
    """
    # whole numbers of sources, positives first: one hashed count of pairs instead of a sorted join
    names = [*quotas, "ann_hard", "random"]
    number = reduce(lambda tail, x: F.when(F.col("source") == x[1], F.lit(x[0])).otherwise(tail), reversed(list(enumerate(quotas, 1))), F.lit(None).cast("int"))
    known = positives.where("user_id is not null and product_id is not null").select("user_id", "product_id", F.lit(0).alias("i"), F.lit(0).alias("rank"))
    both = external.where(F.col("source").isin(*quotas)).select("user_id", "product_id", number.alias("i"), F.lit(0).alias("rank")).unionByName(known)
    if hard > 0 and vectors is not None:
        from fxlake.operators.learning import vector_topk

        near = vector_topk(vectors.join(users.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi"), items, 5 * hard)
        both = both.unionByName(near.select(F.col("query_id").alias("user_id"), F.col("item_id").alias("product_id"), F.lit(len(quotas) + 1).alias("i"), "rank"))
    if total > 0:
        from fxlake.operators.generation import draw

        # as many as leave `total` when positives and the products of other sources are taken out
        liked = known.groupBy("user_id").agg(F.count_distinct("product_id").alias("n"))
        need = users.select("user_id").where("user_id is not null").distinct().join(liked, "user_id", "left").select("user_id", (F.coalesce("n", F.lit(0)) + 2 * total).alias("need"))
        both = both.unionByName(draw(need, products.select("product_id"), seed).select("user_id", "product_id", F.lit(len(quotas) + 2).alias("i"), "rank"))
        both = both.unionByName(need.select("user_id", F.lit(None).cast("string").alias("product_id"), F.lit(-1).alias("i"), F.lit(0).alias("rank")))  # so that each user is there
    of = lambda i: F.min(F.when(F.col("i") == i, F.col("rank")))
    once = both.groupBy("user_id", "product_id").agg(F.min("i").alias("least"), *[of(i).alias(f"r{i}") for i in range(1, len(names) + 1)]).where("least <> 0")
    once = once.withColumn("chosen", F.lit(None).cast("int")).withColumn("h", F.md5(F.concat_ws("\u0000", "user_id", "product_id", F.lit(str(seed)))))
    user = Window.partitionBy("user_id")
    for i, name in enumerate(names, 1):
        free = F.col("chosen").isNull() & F.col(f"r{i}").isNotNull()
        before = F.sum(free.cast("int")).over(user.orderBy(F.col(f"r{i}").asc_nulls_last(), "h", "product_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        most = F.lit(quotas[name]) if name in quotas else F.lit(hard) if name == "ann_hard" else F.lit(total) - F.count("chosen").over(user)
        if name != "random" and 0 < total < sum(quotas.values()) + hard:
            most = F.least(most, F.lit(total) - F.count("chosen").over(user))
        if name in quotas or (name == "ann_hard" and hard > 0) or (name == "random" and total > 0):
            once = once.withColumn("chosen", F.when(free & (before <= most), F.lit(i)).otherwise(F.col("chosen")))
    if total > 0:
        once = once.withColumn("missing", F.when(F.col("least") == -1, F.greatest(F.lit(total) - F.count("chosen").over(user), F.lit(0))))
        once = once.withColumn("copy", F.explode(F.when(F.col("missing") > 0, F.sequence(F.lit(1), F.col("missing"))).when(F.col("chosen").isNotNull(), F.array(F.lit(1)))))
    source = F.when(F.col("chosen").isNull(), "random").otherwise(F.element_at(F.array(*map(F.lit, names)), F.col("chosen")))
    taken = once.where(F.col("chosen").isNotNull() | (F.col("least") == -1)) if total > 0 else once.where("chosen is not null")
    weight = reduce(lambda tail, x: F.when(F.col("source") == x[0], F.lit(x[1])).otherwise(tail), NEGATIVE_WEIGHTS.items(), F.lit(1.0))
    return taken.select("user_id", "product_id", source.alias("source")).withColumn("weight", F.when(F.col("product_id").isNull(), 0.0).otherwise(weight))


def last_positive(rows: DataFrame, events: DataFrame, n: int, bucket_seconds: int = 86400) -> DataFrame:
    """(row_id, action, i, past, event_time): the last n products of each positive action before a row's time, strictly.
    i numbers a user's events of an action by event_time and event_id.

    Events and rows are ordered together, first inside a time bucket, then over buckets, so a hot user is spread over
    its buckets. A row meets the one or two blocks of n numbered events that hold its last n, not the whole history.
    """
    e = events.where(F.col("action").isin(*POSITIVE)).select("user_id", "action", F.col("event_time").alias("t"), "event_id", F.col("product_id").alias("past"), F.lit(1).alias("event"))
    each = rows.select("row_id", "user_id", F.col("as_of").alias("t"), F.explode(F.array(*map(F.lit, POSITIVE))).alias("action"), F.lit(0).alias("event"))
    both = e.unionByName(each, allowMissingColumns=True).withColumn("bucket", F.floor(F.col("t") / bucket_seconds))
    keys = ["user_id", "action", "bucket"]
    # the number of events up to here; at equal times rows come first
    inside = F.sum("event").over(Window.partitionBy(*keys).orderBy("t", "event", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum("n").over(Window.partitionBy("user_id", "action").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = both.groupBy(*keys).agg(F.sum("event").alias("n")).select(*keys, F.coalesce(before, F.lit(0)).alias("start"))
    counted = both.withColumn("inside", inside).join(starts, keys).withColumn("c", F.col("start") + F.col("inside"))
    # the last n of them lie in one or two blocks of n events
    block = lambda i: F.floor(i / n)
    numbered = counted.where("event = 1").select("user_id", "action", "past", F.col("t").alias("event_time"), (F.col("c") - 1).alias("i")).withColumn("block", block(F.col("i")))
    asked = counted.where("event = 0 and c > 0").select("row_id", "user_id", "action", "c")
    asked = asked.withColumn("block", F.explode(F.sequence(block(F.greatest(F.col("c") - n, F.lit(0))), block(F.col("c") - 1))))
    near = asked.join(numbered, ["user_id", "action", "block"]).where((F.col("i") < F.col("c")) & (F.col("i") >= F.col("c") - n))
    return near.select("row_id", "action", "i", "past", "event_time")


def history_embeddings(rows: DataFrame, events: DataFrame, embeddings: DataFrame, n: int = 20) -> DataFrame:
    """Per row and positive action: count, coverage and dot product with the candidate of the scaled mean of the last n
    earlier products' unit vectors. Earlier means strictly before the row's time."""
    last = last_positive(rows, events, n)
    unit = embeddings.select(F.col("product_id").alias("past"), l2_normalize(F.col("vector")).alias("v"))
    candidate = rows.select("row_id", F.col("product_id").alias("past")).join(unit, "past", "left").select("row_id", F.col("v").alias("c"))
    known = last.select("row_id", "action", "past").join(unit, "past", "left").join(candidate, "row_id", "left")
    # the dot product with the mean is the mean of the dot products
    out = known.groupBy("row_id", "action").agg(F.count("*").alias("n"), F.count("v").alias("with_vector"), F.avg(dot(F.col("v"), F.col("c"))).alias("m"))
    scale = reduce(lambda tail, x: F.when(F.col("action") == x[0], F.lit(x[1])).otherwise(tail), ACTION_SCALE.items(), F.lit(1.0))
    return out.select("row_id", "action", "n", F.round(F.col("with_vector") / F.col("n"), 6).alias("coverage"), F.round(scale * F.col("m"), 6).alias("match"))


def user_encoding(users: DataFrame, now: float) -> DataFrame:
    """(user_id, side): ten numbers of a user for a two-tower model. Nulls and missing columns have the defaults below; a
    user without a last activity was active now."""
    get = lambda name, default: F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in users.columns else F.lit(default)
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    total, ctr, cvr = get("total_interactions", 0.0), get("click_through_rate", 0.0), get("conversion_rate", 0.0)
    categories = F.coalesce(F.array_size("preferred_categories"), F.lit(0)) if "preferred_categories" in users.columns else F.lit(0)
    hours = F.greatest((F.lit(now) - get("last_active", now)) / 3600, F.lit(0.0))
    numbers = [F.log1p(total), get("avg_session_length", 0.0) / 3600, get("price_sensitivity", 0.5), ctr, cvr, categories / 10, F.least(hours / 720, F.lit(1.0)), flag(total > 100), flag(cvr > 0.05), flag(ctr > 0.1)]
    return users.select("user_id", F.array(*[F.nanvl(x.cast("float"), F.lit(0.0).cast("float")) for x in numbers]).alias("side"))


def item_encoding(products: DataFrame, now: float) -> DataFrame:
    """(product_id, side): eight numbers of a product for a two-tower model; category and brand by hash bucket."""
    get = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in products.columns else F.lit(default)
    tags = F.coalesce(F.array_size("tags"), F.lit(0)) if "tags" in products.columns else F.lit(0)
    age = F.greatest((F.lit(now) - get("created_at", now)) / 86400, F.lit(0.0))
    bucket = lambda name, n: stable_hash_bucket(get(name, "unknown"), n) / n
    numbers = [F.log1p(get("price", 0.0)), get("rating", 3.0) / 5, F.log1p(get("num_reviews", 0)), F.when(get("in_stock", True), 1.0).otherwise(0.0), F.least(age / 365, F.lit(1.0)), tags / 10, bucket("category", 64), bucket("brand", 128)]
    return products.select("product_id", F.array(*[F.nanvl(x.cast("float"), F.lit(0.0).cast("float")) for x in numbers]).alias("side"))


#: Weight of a sample by action; actions without an entry weigh 1.
SAMPLE_WEIGHTS = {"view": 1.0, "click": 2.0, "add_to_cart": 3.0, "purchase": 5.0, "favorite": 2.5, "share": 1.5}


def two_tower_tables(events: DataFrame, products: DataFrame, embeddings: DataFrame, users: DataFrame, negatives: DataFrame, dim: int, now: float, weights: dict[str, float] = SAMPLE_WEIGHTS) -> dict[str, DataFrame]:
    """What a two-tower model trains on. `users`: number and side numbers of every user of events and negatives; `items`:
    number, vector and side numbers of every product of events, negatives and catalog (zeros without a vector of `dim`
    numbers, defaults without a catalog row); `samples`: (user, item, weight) of each event; `negatives`: theirs, by number.
    Numbers are dense, from 1, in the order of ids; rows without user or product are passed over."""
    known = lambda df: df.where("coalesce(user_id, '') <> '' and coalesce(product_id, '') <> ''")
    e, neg = known(events), known(negatives)
    user_ids = dense_ids(e.select("user_id").union(neg.select("user_id")), "user_id", "user")
    item_ids = dense_ids(e.select("product_id").union(neg.select("product_id")).union(products.select("product_id")), "product_id", "item")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    vectors = embeddings.where(F.size("vector") == dim).select("product_id", F.col("vector").cast("array<float>").alias("v"))
    facts = item_encoding(item_ids.select("product_id").join(products, "product_id", "left"), now)
    items = item_ids.join(vectors, "product_id", "left").join(facts, "product_id").select("item", "product_id", F.coalesce("v", zeros).alias("vector"), "side")
    sides = user_encoding(user_ids.select("user_id").join(users, "user_id", "left"), now)
    weight = reduce(lambda tail, x: F.when(F.col("action") == x[0], F.lit(x[1])).otherwise(tail), weights.items(), F.lit(1.0))
    number = lambda df: df.join(user_ids, "user_id").join(item_ids, "product_id")
    return {
        "users": user_ids.join(sides, "user_id").select("user", "user_id", "side"), "items": items,
        "samples": number(e).select("user", "item", weight.alias("weight")), "negatives": number(neg).select("user", "item", *[c for c in neg.columns if c not in ("user_id", "product_id")]),
    }


def missing_artifacts(jobs: DataFrame, artifacts: DataFrame, schema: int) -> DataFrame:
    """Completed jobs without an artifact, or with one of another schema version."""
    both = jobs.where("status = 'completed'").join(artifacts, "job_id", "left")
    return both.where(F.col("schema_version").isNull() | (F.col("schema_version") != schema)).select("job_id", F.when(F.col("schema_version").isNull(), "missing").otherwise("old_schema").alias("reason"))


def pending_outbox(outbox: DataFrame, activations: DataFrame, now: float) -> DataFrame:
    """Unpublished rows of completed activations: how many, and the oldest one's age."""
    rows = outbox.where("not published").join(activations.where("status = 'completed'").select("activation_id"), "activation_id")
    return rows.groupBy("activation_id").agg(F.count("*").alias("pending"), F.round(F.lit(now) - F.min("created_at"), 6).alias("oldest_age"))


def recommendation_metrics(recommended: DataFrame, events: DataFrame) -> DataFrame:
    """Per product: times recommended, clicks a recommendation, purchases a click."""
    shown = recommended.groupBy("product_id").agg(F.count("*").alias("shown"))
    done = events.groupBy("product_id").agg(F.count_if(F.col("action") == "click").alias("clicks"), F.count_if(F.col("action") == "purchase").alias("purchases"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0), 6)
    return shown.join(done, "product_id", "left").select("product_id", "shown", ratio("clicks", "shown").alias("ctr"), ratio("purchases", "clicks").alias("cvr"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """One row: the last success, whether a run waits or runs, and the latest run."""
    return runs.agg(
        F.max(F.when(F.col("status") == "completed", F.col("finished_at"))).alias("last_success"), F.max((F.col("status") == "waiting").cast("int")).alias("waiting"),
        F.max((F.col("status") == "running").cast("int")).alias("running"), F.max_by("run_id", F.struct("started_at", "run_id")).alias("latest_run"),
    )


def segment_turns(turns: DataFrame, pause: float = 0.8, most_seconds: float = 5.0, most_chars: int = 96) -> DataFrame:
    """Transcript tokens of each conversation folded into segments: a new one after a pause, a span above five seconds,
    or more than 96 characters. The fold runs over the sorted array of one conversation."""
    token = F.struct("turn", "text", "start", "stop")
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    none = F.array().cast("array<struct<text:string,start:double,stop:double>>")

    def fold(done: Column, t: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(last["text"], F.lit(" "), t["text"])
        apart = last.isNull() | (t["start"] - last["stop"] >= pause) | (t["stop"] - last["start"] > most_seconds) | (F.char_length(joined) > most_chars)
        alone = F.struct(t["text"].alias("text"), t["start"].alias("start"), t["stop"].alias("stop"))
        more = F.struct(joined.alias("text"), last["start"].alias("start"), t["stop"].alias("stop"))
        return F.when(apart, F.concat(done, F.array(alone))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(more)))

    out = lists.select("conv_id", F.posexplode(F.aggregate("tokens", none, fold)).alias("segment", "s"))
    return out.select("conv_id", "segment", F.char_length("s.text").alias("chars"), F.round("s.start", 6).alias("start"), F.round("s.stop", 6).alias("stop"))
