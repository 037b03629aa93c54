"""Structured Streaming forms of the feature operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from fxlake.operators.windows import WINDOWS, _count, entity_fanout, slide_counts

EVENT = "event_id string, user_id string, product_id string, action string, product_category string, session_length double, event_ts timestamp, event_time double, available_at double"


def read_interactions(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """A stream of event files. For Kafka, parse the value column with parse_events and go on in the same way."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON text -> typed events and an `error` (null for good rows): not JSON, or a blank id or action. Unknown
    fields are ignored; category and session length come from `context`."""
    parsed = lines.withColumn("j", F.from_json(value, "event_id string, user_id string, product_id string, action string, event_time double, context struct<product_category:string,session_length:double>", {"mode": "PERMISSIVE"}))
    blank = lambda c: F.trim(F.coalesce(f"j.{c}", F.lit(""))) == ""
    error = F.when(F.try_parse_json(value).isNull(), "not_json")
    for c in ("event_id", "user_id", "product_id", "action"):
        error = F.coalesce(error, F.when(blank(c), f"missing_{c}"))
    error = F.coalesce(error, F.when(F.coalesce("j.event_time", F.lit(0.0)) <= 0, "bad_time"))
    return parsed.select(
        F.col(value).alias("raw"), "j.event_id", "j.user_id", "j.product_id", F.lower("j.action").alias("action"), F.col("j.context.product_category").alias("product_category"),
        F.col("j.context.session_length").alias("session_length"), F.timestamp_micros((F.col("j.event_time") * 1000000).cast("long")).alias("event_ts"), F.col("j.event_time").alias("event_time"), error.alias("error"),
    )


def dedupe_stream(events: DataFrame, ttl: str = "7 days", key: str = "event_id") -> DataFrame:
    """The first event of each id within the TTL."""
    return events.withWatermark("event_ts", ttl).dropDuplicatesWithinWatermark([key])


def stream_windows(events: DataFrame, name: str, lateness: str = "15 minutes") -> DataFrame:
    """Sliding counts as a stream: use update mode, where a late event within the lateness re-emits its windows."""
    size, slide = WINDOWS[name]
    return entity_fanout(events.withWatermark("event_ts", lateness)).groupBy("entity_type", "entity_id", F.window("event_ts", size, slide).alias("w")).agg(
        _count("view").alias("views"), _count("click").alias("clicks"), _count("add_to_cart").alias("add_to_carts"),
        _count("purchase").alias("purchases"), F.count("*").alias("total_events"),
    ).select("entity_type", "entity_id", F.unix_seconds("w.start").cast("double").alias("window_start"), "views", "clicks", "add_to_carts", "purchases", "total_events")


def stream_slides(events: DataFrame, name: str, lateness: str = "15 minutes") -> DataFrame:
    """Counts of each slide as a stream, in update mode: `windows_of_slides` adds the latest ones up. An event has one slide,
    so the state is that of its slides and not of all windows that cover it (24 a day's window)."""
    return slide_counts(events.withWatermark("event_ts", lateness), name)


SNAPSHOT = "user_id string, source_event_id string, event_time double, total_interactions long, views long, clicks long, purchases long, last_active double"


def stream_user_features(events: DataFrame) -> DataFrame:
    """A running snapshot of each user after each event; a batch's events are folded by time and id."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = list(state.get) if state.exists else [0, 0, 0, 0, 0.0]
        rows = pd.concat(list(batches)).sort_values(["event_time", "event_id"])
        out = []
        for event_id, action, t in zip(rows["event_id"], rows["action"], rows["event_time"], strict=True):
            total[0] += 1
            for i, name in enumerate(("view", "click", "purchase"), 1):
                total[i] += action == name
            total[4] = max(total[4], t)
            out.append((key[0], event_id, t, *total))
        state.update(tuple(total))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SNAPSHOT.split(", ")])

    return events.groupBy("user_id").applyInPandasWithState(fold, SNAPSHOT, "n long, views long, clicks long, purchases long, last double", "append", "NoTimeout")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Process all that is there, batch by batch, into Parquet at path/data. Each batch has a folder of its own that it
    overwrites, so a batch that is run again after a failure leaves the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/batch={number}x")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def split_errors(parsed: DataFrame, path: str) -> None:
    """Good rows to path/events, rejected ones with their raw text and reason to path/dlq, batch by batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("error is null").drop("raw", "error").write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        batch.where("error is not null").select("raw", "error").write.mode("overwrite").parquet(f"{path}/dlq/batch={number}")
        batch.unpersist()

    parsed.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def latest_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key from the latest batch: what an upsert would hold."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch").alias("r")).select(*keys, "r.*")


def online_snapshot(rows: DataFrame, keys: list[str], now: float, ttl: float) -> DataFrame:
    """Latest value of each key with its expiry."""
    return latest_of(rows, keys).withColumn("expires_at", F.lit(now + ttl)).drop("batch")
