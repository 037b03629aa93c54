"""Sliding-window features, user profiles and sequences over interactions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fxlake.functions.batches import changes, whole_groups
from fxlake.session import ship_package

#: name -> (size, slide)
WINDOWS = {"5m": ("5 minutes", "1 minute"), "1h": ("1 hour", "5 minutes"), "24h": ("24 hours", "1 hour")}
POSITIVE = ("click", "add_to_cart", "purchase")
#: Actions of user sequences; the candidate model's histories (POSITIVE) leave out views.
SEQUENCE = ("view", *POSITIVE)


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d within [0, 1]; 0 where d isn't positive."""
    return F.when(d <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n / d)))


def _count(action: str) -> Column:
    return F.count_if(F.col("action") == action)


def entity_fanout(events: DataFrame) -> DataFrame:
    """Each event for its user, its product and, unless blank, its category."""
    named = lambda kind, c: F.struct(F.lit(kind).alias("entity_type"), F.col(c).alias("entity_id"))
    out = events.withColumn("e", F.explode(F.array(named("user", "user_id"), named("product", "product_id"), named("category", "product_category"))))
    return out.select("*", "e.entity_type", "e.entity_id").drop("e").where("entity_id is not null and (entity_type <> 'category' or trim(entity_id) <> '')")


#: What is counted in each slide and window.
COUNTS = ("views", "clicks", "add_to_carts", "purchases", "total_events")


def slide_seconds(name: str) -> tuple[int, int]:
    """Seconds of a slide, and slides of a window."""
    size, slide = (pd.Timedelta(x) // pd.Timedelta("1s") for x in WINDOWS[name])
    return slide, size // slide


def slide_counts(events: DataFrame, name: str, ts: str = "event_ts") -> DataFrame:
    """(entity_type, entity_id, slide, COUNTS): an entity's events in each slide that has some; slides are numbered from 1970."""
    out = entity_fanout(events).groupBy("entity_type", "entity_id", F.window(ts, WINDOWS[name][1]).alias("w")).agg(
        _count("view").alias("views"), _count("click").alias("clicks"), _count("add_to_cart").alias("add_to_carts"),
        _count("purchase").alias("purchases"), F.count("*").alias("total_events"),
    )
    return out.select("entity_type", "entity_id", F.expr(f"unix_seconds(w.start) div {slide_seconds(name)[0]}").alias("slide"), *COUNTS)


def _sliding(length: int, table: pa.Table) -> pa.RecordBatch:
    """Windows of `length` slides over whole entities' slides, in order. A slide gives the windows that begin after the
    slide before it, and a difference of running sums counts each of them."""
    slide = table["slide"].to_numpy()
    fresh = np.r_[True, changes(table["entity_type"]) | changes(table["entity_id"])]
    before = np.where(fresh, slide - length, np.r_[0, slide[:-1]])
    given = np.minimum(length, slide - before)
    row = np.repeat(np.arange(len(slide)), given)
    start = slide[row] - (np.cumsum(given)[row] - 1 - np.arange(len(row)))
    low = int(slide.min())
    place = np.cumsum(fresh) * (int(slide.max()) - low + 2 * length + 1) - low
    end = np.searchsorted(slide + place, start + length + place[row], "left")
    sums = [np.r_[0, np.cumsum(table[c].to_numpy())] for c in COUNTS]
    ids = [table[c].combine_chunks().take(pa.array(row)) for c in ("entity_type", "entity_id")]
    return pa.RecordBatch.from_arrays([*ids, pa.array(start), *[pa.array(s[end] - s[row]) for s in sums]], ["entity_type", "entity_id", "start", *COUNTS])


def windows_of_slides(slides: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """(entity_type, entity_id, window_start, COUNTS) of each window that has events, from `slide_counts`.

    Slides of an entity, which time bounds and not its events, lie together and in order; the windows that cover them are
    made there, so no window is shuffled, hashed or sorted. `parts` fixes the number of tasks where much is made of each
    window: else it follows from the slides' bytes, which are few.
    """
    ship_package(slides.sparkSession)
    seconds, length = slide_seconds(name)
    together = slides.select("entity_type", "entity_id", "slide", *COUNTS).repartition(*([parts] if parts else []), "entity_type", "entity_id").sortWithinPartitions("entity_type", "entity_id", "slide")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "entity_type", "entity_id"):
            yield _sliding(length, table)

    counts = ", ".join(f"{c} long" for c in COUNTS)
    out = together.mapInArrow(made, f"entity_type string, entity_id string, start long, {counts}")
    return out.select("entity_type", "entity_id", (F.col("start") * seconds).cast("double").alias("window_start"), *COUNTS)


def window_features(events: DataFrame, name: str, ts: str = "event_ts", parts: int | None = None) -> DataFrame:
    """Counts and ratios of each entity in each sliding window that has events.

    Events are counted once for each slide first (partial sums before the shuffle), and slides are then added up into
    the windows that cover them, so a day's window of hourly slides moves hourly counts and not 24 copies of events.
    """
    seconds, length = slide_seconds(name)
    return windows_of_slides(slide_counts(events, name, ts), name, parts).select(
        "entity_type", "entity_id", F.lit(name).alias("window"), *COUNTS,
        F.round(safe_ratio(F.col("clicks"), F.col("views")), 6).alias("click_through_rate"),
        F.round(safe_ratio(F.col("purchases"), F.col("clicks")), 6).alias("conversion_rate"),
        "window_start", (F.col("window_start") + seconds * length).alias("window_end"),
    )


def all_window_features(events: DataFrame) -> DataFrame:
    out = None
    for name in WINDOWS:
        one = window_features(events, name)
        out = one if out is None else out.unionByName(one)
    return out


def user_features(events: DataFrame, most_categories: int = 10) -> DataFrame:
    """Totals, mean session length, first categories seen, clamped ratios and the latest event of each user."""
    seen = events.where("trim(coalesce(product_category, '')) <> ''").groupBy("user_id", "product_category").agg(F.min(F.struct("event_time", "event_id")).alias("first"))
    categories = seen.groupBy("user_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("first", "product_category"))), 1, most_categories), lambda x: x["product_category"]).alias("preferred_categories"))
    totals = events.groupBy("user_id").agg(
        F.count("*").alias("total_interactions"), F.round(F.coalesce(F.avg("session_length"), F.lit(0.0)), 6).alias("avg_session_length"),
        _count("view").alias("views"), _count("click").alias("clicks"), _count("purchase").alias("purchases"),
        F.max("event_time").alias("last_active"), F.max_by("event_id", F.struct("event_time", "event_id")).alias("source_event_id"),
    )
    return totals.join(categories, "user_id", "left").select(
        "user_id", "total_interactions", "avg_session_length", F.coalesce("preferred_categories", F.array().cast("array<string>")).alias("preferred_categories"),
        F.lit(0.5).alias("price_sensitivity"),
        F.round(safe_ratio(F.col("clicks"), F.greatest("views", F.lit(1))), 6).alias("click_through_rate"),
        F.round(safe_ratio(F.col("purchases"), F.greatest("clicks", F.lit(1))), 6).alias("conversion_rate"),
        "last_active", "source_event_id",
    )


def running_user_features(events: DataFrame) -> DataFrame:
    """A user's totals after each of their events, by time and id: the history that point-in-time joins read."""
    w = Window.partitionBy("user_id").orderBy("event_time", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = lambda action: F.sum((F.col("action") == action).cast("long")).over(w)
    out = events.select(
        "user_id", "event_id", "event_time", "available_at", F.count("*").over(w).alias("total_interactions"),
        running("view").alias("views"), running("click").alias("clicks"), running("purchase").alias("purchases"), F.max("event_time").over(w).alias("last_active"),
    )
    return out.select(
        "user_id", F.col("event_id").alias("source_event_id"), "event_time", "available_at", "total_interactions",
        F.round(safe_ratio(F.col("clicks"), F.greatest("views", F.lit(1))), 6).alias("click_through_rate"),
        F.round(safe_ratio(F.col("purchases"), F.greatest("clicks", F.lit(1))), 6).alias("conversion_rate"), "last_active",
    )


def batch_user_delta(features: DataFrame, events: DataFrame) -> DataFrame:
    """Stored user rows after a micro-batch: totals, the running session mean, unclamped ratios, later activity."""
    delta = events.groupBy("user_id").agg(
        F.count("*").alias("d_total"), F.sum("session_length").alias("d_sum"), F.count("session_length").alias("d_sessions"),
        _count("view").alias("d_views"), _count("click").alias("d_clicks"), _count("purchase").alias("d_purchases"), F.max("event_time").alias("d_last"),
    )
    old = lambda c: F.coalesce(c, F.lit(0))
    both = features.join(delta, "user_id", "full")
    views, clicks, purchases = (old(c) + old(f"d_{c}") for c in ("views", "clicks", "purchases"))
    sessions = old("sessions") + old("d_sessions")
    mean = (F.coalesce("avg_session_length", F.lit(0.0)) * old("sessions") + F.coalesce("d_sum", F.lit(0.0))) / F.greatest(sessions, F.lit(1))
    return both.select(
        "user_id", (old("total_interactions") + old("d_total")).alias("total_interactions"), F.round(mean, 4).alias("avg_session_length"), sessions.alias("sessions"),
        views.alias("views"), clicks.alias("clicks"), purchases.alias("purchases"),
        F.round(clicks / F.greatest(views, F.lit(1)), 6).alias("click_through_rate"), F.round(purchases / F.greatest(clicks, F.lit(1)), 6).alias("conversion_rate"),
        F.greatest("last_active", "d_last").alias("last_active"),
    )


def analytics_summary(events: DataFrame, now: float, hours: int = 24) -> DataFrame:
    recent = events.where((F.col("event_time") > now - 3600 * hours) & (F.col("event_time") <= now))
    rate = lambda a, b: F.round(F.when(_count(b) > 0, _count(a) / _count(b)).otherwise(0.0), 4)
    return recent.agg(
        F.count("*").alias("total_events"), F.countDistinct("user_id").alias("unique_users"), F.countDistinct("product_id").alias("unique_products"),
        *[_count(a).alias(f"n_{a}") for a in ("view", "click", "add_to_cart", "purchase")], rate("click", "view").alias("ctr"), rate("purchase", "click").alias("cvr"),
    )


def user_sequences(events: DataFrame, most: int = 200, least: int = 2) -> DataFrame:
    """The last `most` positive events of users who have at least `least`, oldest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_time"), F.desc("event_id"))
    last = events.where(F.col("action").isin(*SEQUENCE)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    out = last.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_time", "event_id", "product_id", "action"))).alias("sequence"))
    return out.where(F.size("sequence") >= least)


def eligible_users(events: DataFrame, most: int, least: int = 2) -> DataFrame:
    out = events.where(F.col("action").isin(*SEQUENCE)).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_time").alias("last_active"))
    return out.where(F.col("n") >= least).orderBy(F.desc("last_active"), "user_id").limit(most)


def sequence_tokens(sequences: DataFrame, most: int = 200) -> DataFrame:
    """Length of each sequence and its latest event."""
    last = F.element_at("sequence", -1)
    return sequences.select("user_id", F.least(F.size("sequence"), F.lit(most)).cast("long").alias("length"), last["event_id"].alias("event_id"), last["event_time"].alias("event_time"), last["product_id"].alias("product_id"), last["action"].alias("action"))


def keep_recent(events: DataFrame, per_user: int = 1000, per_action: int = 200) -> DataFrame:
    newest = [F.desc("event_time"), F.desc("event_id")]
    out = events.select("*", F.row_number().over(Window.partitionBy("user_id").orderBy(*newest)).alias("a"), F.row_number().over(Window.partitionBy("user_id", "action").orderBy(*newest)).alias("b"))
    return out.where((F.col("a") <= per_user) & (F.col("b") <= per_action)).drop("a", "b")


def keyset_page(df: DataFrame, after: tuple[float, str], n: int) -> DataFrame:
    t, i = after
    later = (F.col("event_time") > t) | ((F.col("event_time") == t) & (F.col("event_id") > i))
    return df.where(later).orderBy("event_time", "event_id").limit(n)


def latest_row(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by `order`: a hash aggregate, no sort."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def recent_events(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("event_time"), F.desc("event_id")).limit(n)
