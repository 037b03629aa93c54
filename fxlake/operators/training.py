"""Reading of recommendation events, and the training matrix: feature vectors, labels, values and groups of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fxlake.functions.scalars import canonical_json, feature_snapshot, payload_hash, stable_hash_bucket
from fxlake.operators import features as X
from fxlake.operators import learning as L

SCORES = ("collaborative_score", "content_similarity_score", "popularity_score", "combined_score")


def read_recommendations(events: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(impressions, items) of JSON events. Metadata wins over the top level for the impression and the displayed
    items, the top level for user and request. Items that are no object or have no product are passed over; events
    without impression, user or any item left give no row."""
    top, meta = (lambda n: F.get_json_object(raw, f"$.{n}")), (lambda n: F.get_json_object(raw, f"$.metadata.{n}"))
    own = lambda n: F.get_json_object("item", f"$.{n}")
    shown = F.filter(F.from_json(F.coalesce(meta("displayed_items"), top("displayed_items")), "array<string>"), lambda i: F.get_json_object(i, "$.product_id").isNotNull())
    asked = F.struct(F.coalesce(meta("impression_id"), top("impression_id")).alias("impression_id"), F.coalesce(top("user_id"), meta("user_id")).alias("user_id"), shown.alias("shown"))
    # what filters ask for comes out of an explode, so that they aren't pushed into the parsing and read each text again
    parsed = events.select(raw, F.explode(F.array(asked)).alias("asked")).where("asked.impression_id is not null and asked.user_id is not null and size(asked.shown) > 0")
    parsed = parsed.select(
        "asked.impression_id", "asked.user_id",
        F.coalesce(top("request_id"), meta("request_id")).alias("request_id"), F.coalesce(meta("session_id"), meta("context.session_id")).alias("session_id"),
        meta("content_id").alias("content_id"), meta("model_version").alias("model_version"), F.coalesce(meta("context"), meta("request_context")).alias("context"),
        "asked.shown",
    )
    items = parsed.select("impression_id", F.explode("shown").alias("item")).select(
        "impression_id", own("product_id").alias("product_id"), F.coalesce(own("position").try_cast("int"), F.lit(0)).alias("position"),
        F.coalesce(own("source"), own("candidate_source")).alias("source"), feature_snapshot(F.col("item")).alias("feature_snapshot"),
        *[F.coalesce(own(f"scores.{s}"), own(s)).try_cast("double").alias(s) for s in SCORES],
    )
    return parsed.withColumn("n_items", F.size("shown")).drop("shown"), items


def assemble_features(rows: DataFrame, as_of: str = "as_of", out: str = "features") -> DataFrame:
    """Add the base vector as array<float>: 10 values of the user, 8 of the product, 6 of the context, 4 of the candidate.

    Columns that the rows lack, and nulls, have the defaults below. Hour and weekday are UTC. A value that is not
    finite fails the job.
    """
    get = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    count = lambda name: F.coalesce(F.array_size(F.col(name)), F.lit(0)) if name in rows.columns else F.lit(0)
    now = F.col(as_of)
    days = lambda name: (now - (F.coalesce(F.col(name), now) if name in rows.columns else now)) / 86400
    weekday = F.pmod(F.floor(now / 86400) + 3, F.lit(7))  # the epoch was a Thursday
    total, ctr, cvr = get("total_interactions", 0), get("click_through_rate", 0.0), get("conversion_rate", 0.0)
    user = [total / 1000, get("avg_session_length", 0.0) / 3600, get("price_sensitivity", 0.0), ctr, cvr, count("preferred_categories") / 10, days("last_active"), flag(total > 100), flag(cvr > 0.05), flag(ctr > 0.1)]
    brand = stable_hash_bucket(get("brand", ""), 100) / 100
    product = [F.log1p(get("price", 1.0)), get("rating", 3.0) / 5, F.log1p(get("num_reviews", 1)), flag(get("in_stock", True)), days("created_at"), count("tags") / 10, flag(get("price", 0.0) > 100), brand]
    context = [F.pmod(F.floor(now / 3600), F.lit(24)) / 24, weekday / 6, flag(weekday >= 5), get("session_position", 1) / 20, flag(get("device", "") == "mobile"), get("time_on_page", 0) / 300]
    vector = F.array(*[c.cast("float") for c in [*user, *product, *context, *[get(s, 0.0) for s in SCORES]]])
    bad = F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn(out, F.when(bad, F.raise_error(F.lit("a feature is not finite"))).otherwise(vector))


def bundle_hash(numbers: dict[str, Column], texts: dict[str, Column], sequences: Column | None = None) -> Column:
    """SHA-256 of the canonical JSON of what a training row was joined from. `sequences` (a string) is part of it only
    where it is present, so rows without sequences keep their hash."""
    fields = {n: (c, "number") for n, c in numbers.items()} | {n: (c, "string") for n, c in texts.items()}
    plain = canonical_json(fields)
    if sequences is None:
        return payload_hash(plain)
    return payload_hash(F.when(sequences.isNull(), plain).otherwise(canonical_json(fields | {"sequences": (sequences, "string")})))


def training_matrix(rows: DataFrame, least: int = 20) -> DataFrame:
    """Features, labels, value bucket, normalised value and group of each point-in-time row.

    rows have what `assemble_features` and `build_labels` read, and a `bucket`. Values are normalised by the statistics
    of the rows that have one; rows without have 0. Groups are dense numbers of impressions. Rows whose labels contradict
    each other, or whose values are not finite, fail the job.
    """
    labels = L.build_labels(rows).withColumnRenamed("value", "business_value")
    bad = F.col("error").isNotNull() | F.isnan("business_value") | (F.abs("business_value") == float("inf"))
    labels = labels.withColumn("business_value", F.when(bad, F.raise_error(F.coalesce("error", F.lit("a value is not finite"))).cast("double")).otherwise(F.col("business_value")))
    kept = assemble_features(rows).select("observation_id", "impression_id", "bucket", "features").join(labels.drop("error"), "observation_id")
    values = kept.where("value_mask = 1").select(F.col("observation_id").alias("row_id"), "bucket", F.col("business_value").alias("value"))
    scaled = L.transform_values(values, L.value_stats(values, least)).select(F.col("row_id").alias("observation_id"), "z")
    groups = X.dense_ids(rows, "impression_id", "group_id")
    out = kept.join(scaled, "observation_id", "left").join(groups, "impression_id")
    return out.withColumn("value", F.coalesce("z", F.lit(0.0))).drop("z")


def choose_training_rows(point_in_time: DataFrame | None, slates: DataFrame, events: DataFrame, least: int, coverage: float) -> tuple[DataFrame | None, str]:
    """The rows to train on and why: point-in-time rows if given (none below the coverage of `has_sequence`), else slates
    if there are enough, else the newest events. Counts decide; rows stay where they are."""
    if point_in_time is not None:
        n, share = point_in_time.agg(F.count("*"), F.avg(F.coalesce(F.col("has_sequence").cast("double"), F.lit(0.0)))).first()
        if n < least:
            return None, "too_few_point_in_time_rows"
        return (point_in_time, "point_in_time") if share >= coverage else (None, "low_sequence_coverage")
    for rows, reason in ((slates, "slates"), (events, "events")):
        if rows.count() >= least:
            return rows, reason
    return None, "too_few_rows"


def as_text(vector: str, scale: int = 10_000) -> Column:
    """A vector as whole numbers of 1 / scale, joined by commas."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * scale).cast("bigint").cast("string")), ",")

