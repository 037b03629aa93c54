"""Point-in-time joins: as-of features, interval feedback, training and quarantine rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a purchase's value, in order.
VALUE_KEYS = ("margin", "profit", "gross_margin", "value", "gmv", "purchase_value", "price")
SCORES = ("collaborative_score", "content_similarity_score", "popularity_score")


def asof_latest(observations: DataFrame, history: DataFrame, key: str, values: list[str], bucket_seconds: int = 86400) -> DataFrame:
    """observations (left) with `values` of the latest history row of the same key and version whose event_time and
    available_at are both at most as_of; ties by event_time, available_at, source_event_id, the last one.

    No join of rows: history becomes visible at max(event_time, available_at); the greatest record so far is a
    running maximum over history and observations together. The maximum has two levels - before the time bucket, and
    inside it - so a key with very many rows is spread over its buckets instead of one task.
    """
    record = F.struct("event_time", "available_at", "source_event_id", *values)
    past = history.select(F.col(key).alias("__k"), F.col("version").alias("__v"), F.greatest("event_time", "available_at").alias("__t"), record.alias("__record"))
    now = observations.select(F.col(key).alias("__k"), F.col("version").alias("__v"), F.col("as_of").alias("__t"), F.struct(*observations.columns).alias("__row"))
    both = past.unionByName(now, allowMissingColumns=True).withColumn("__bucket", F.floor(F.col("__t") / bucket_seconds))
    inside = Window.partitionBy("__k", "__v", "__bucket").orderBy("__t")  # up to and with equal times
    seen = both.select("*", F.max("__record").over(inside).alias("__near")).where("__row is not null")
    buckets = both.groupBy("__k", "__v", "__bucket").agg(F.max("__record").alias("__top"))
    before = Window.partitionBy("__k", "__v").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = buckets.select("__k", "__v", "__bucket", F.max("__top").over(before).alias("__far"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("__k", "__v", "__bucket")]
    out = seen.alias("a").join(earlier.alias("b"), reduce(Column.__and__, same), "left")
    best = F.greatest("a.__near", "b.__far")
    return out.select("a.__row.*", best.alias("__best")).select(*observations.columns, *[F.col(f"__best.{v}").alias(v) for v in values], F.col("__best.source_event_id").alias(f"{key}_source"))


def eligible_observations(observations: DataFrame, version: str, cutoff: float, attribution_hours: int, lateness_hours: int) -> DataFrame:
    """Observations whose attribution window and lateness are over by the cutoff."""
    return observations.where((F.col("version") == version) & (F.col("as_of") <= cutoff - (attribution_hours + lateness_hours) * 3600))


def feedback_interval(observations: DataFrame, interactions: DataFrame, hours: int, cutoff: float) -> DataFrame:
    """Each observation with the interactions of the same user and product within `hours`, or with none.

    The equality on a time bucket (the observation's and the following ones) narrows the sort-merge join, so that a
    hot user and product doesn't pair all its history.
    """
    span = hours * 3600
    o = observations.select("observation_id", "user_id", "product_id", "as_of")
    context = F.col("context_json") if "context_json" in interactions.columns else F.lit(None).cast("string")
    i = interactions.where(F.col("available_at") <= cutoff).select("user_id", "product_id", "action", context.alias("context_json"), "event_time", "available_at", F.col("event_id").alias("source_event_id"), F.floor(F.col("event_time") / span).alias("__b"))
    buckets = o.withColumn("__b", F.explode(F.sequence(F.floor(F.col("as_of") / span), F.floor((F.col("as_of") + span) / span))))
    found = buckets.join(i, ["user_id", "product_id", "__b"]).where((F.col("event_time") >= F.col("as_of")) & (F.col("event_time") <= F.col("as_of") + span))
    found = found.select("observation_id", "action", "context_json", "event_time", "available_at", "source_event_id")
    return o.select("observation_id").join(found, "observation_id", "left")


def attribution(feedback: DataFrame) -> DataFrame:
    """Per observation: strongest action, click and purchase flags, and the value in the latest purchase's context with its key."""
    rank = F.when(F.col("action") == "purchase", 3).when(F.col("action") == "add_to_cart", 2).when(F.col("action") == "click", 1).otherwise(0)
    bought = F.col("action") == "purchase"
    latest = F.max(F.when(bought, F.struct("event_time", "available_at", "source_event_id", "context_json")))
    out = feedback.groupBy("observation_id").agg(F.max(rank).alias("r"), F.max(F.when(rank > 0, 1).otherwise(0)).alias("attributed_click"), F.max(F.when(bought, 1).otherwise(0)).alias("attributed_purchase"), latest.alias("l"))
    action = F.when(F.col("r") == 3, "purchase").when(F.col("r") == 2, "add_to_cart").when(F.col("r") == 1, "click").otherwise("view")
    value, source = first_numeric(F.col("l.context_json"))
    return out.select("observation_id", action.alias("attributed_action"), "attributed_click", "attributed_purchase", value.alias("attributed_value"), source.alias("attributed_value_source"))


def first_numeric(json: Column, keys: tuple[str, ...] = VALUE_KEYS) -> tuple[Column, Column]:
    """The first key's value that reads as a number, and the first key that is there at all, whatever its value."""
    texts = {k: F.get_json_object(json, f"$.{k}") for k in keys}
    return F.coalesce(*[t.try_cast("double") for t in texts.values()]), F.coalesce(*[F.when(t.isNotNull(), F.lit(k)) for k, t in texts.items()])


def scored_base(observations: DataFrame, user_history: DataFrame, item_history: DataFrame, interactions: DataFrame, *, version: str, cutoff: float, attribution_hours: int, lateness_hours: int) -> DataFrame:
    """Eligible observations with user and item features, feedback, and the reason why a row can't be trained on."""
    base = eligible_observations(observations, version, cutoff, attribution_hours, lateness_hours)
    joined = asof_latest(base, user_history, "user_id", ["total_interactions", "click_through_rate"])
    joined = asof_latest(joined, item_history, "product_id", ["price"])
    labels = attribution(feedback_interval(base, interactions, attribution_hours, cutoff))
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in SCORES])
    reason = F.coalesce(
        F.when(F.col("impression_id").isNull(), "missing_impression_id"),
        F.when(F.col("context").isNull(), "missing_context"),
        F.when(missing, "missing_candidate_scores"),
        F.when(F.col("user_id_source").isNull(), "missing_user_feature"),
        F.when(F.col("product_id_source").isNull(), "missing_complete_v1_item_snapshot"),
    )
    return joined.join(labels, "observation_id", "left").withColumn("reason", reason)


TRAINING = [
    "observation_id", "impression_id", "user_id", "product_id", "as_of", "attributed_action", "attributed_click", "attributed_purchase",
    "attributed_value", "total_interactions", "click_through_rate", "price", "user_id_source", "product_id_source",
]


def training_rows(base: DataFrame) -> DataFrame:
    return base.where("reason is null").select(*TRAINING)


def quarantine_rows(base: DataFrame) -> DataFrame:
    return base.where("reason is not null").select("observation_id", "reason", "as_of")


def pit_stats(base: DataFrame) -> DataFrame:
    return base.agg(
        F.count("*").alias("rows"), F.count_if(F.col("reason").isNull()).alias("training_rows"),
        F.count_if(F.col("reason").isNotNull()).alias("quarantine_rows"), F.min("as_of").alias("min_as_of"), F.max("as_of").alias("max_as_of"),
    )


def run_row_count(*tables: DataFrame) -> DataFrame:
    counts = [t.agg(F.count("*").alias("n")) for t in tables]
    return reduce(DataFrame.unionAll, counts).agg(F.sum("n").alias("rows"))
