"""Catalog activation: a version of the catalog as history events that become effective together or not at all."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.functions.contracts import canonical_object, json_text
from fxlake.functions.scalars import deterministic_id
from fxlake.sources.sealed import rows_digest
from fxlake.streaming.history import feature_event


def activation_id(source_version: str) -> str:
    """The same for the same version."""
    if not source_version.strip():
        raise ValueError("a catalog needs a version")
    return hashlib.sha256(f"catalog_activation\0{source_version.strip()}".encode()).hexdigest()


def prepare_catalog_activation(products: DataFrame, source_version: str, event_time: float, available_at: float) -> tuple[DataFrame, dict]:
    """(outbox, activation): an event for each product (product_id, snapshot as JSON text) and what the version must come to:
    its id, how many products, and a digest of ids and snapshots that doesn't depend on rows' order or partitioning.

    Products without an id, without a JSON object, or given twice fail: a version is whole or it isn't one.
    """
    own, version = activation_id(source_version), source_version.strip()
    rows = products.select(F.trim("product_id").alias("product_id"), canonical_object(F.col("snapshot")).alias("payload"))
    rows = rows.withColumn("payload_hash", F.sha2("payload", 256))
    checked = rows.agg(F.count("*").alias("n"), F.count_if((F.coalesce("product_id", F.lit("")) == "") | F.col("payload").isNull()).alias("bad")).first()
    if checked["bad"]:
        raise ValueError(f"{checked['bad']} products without an id or a snapshot")
    if not rows.groupBy("product_id").count().where("count > 1").isEmpty():
        raise ValueError("a product is given twice")
    event_id = deterministic_id(F.col("product_id"), F.lit(version))
    event = feature_event("catalog_feature", "item", F.col("product_id"), F.lit(event_time), F.lit(available_at), event_id, F.lit(version), F.col("payload"), activation_id=json_text(F.lit(own)))
    outbox = rows.select(event_id.alias("event_id"), F.lit(own).alias("activation_id"), "product_id", "payload", "payload_hash", event.alias("value"), F.lit(event_time).alias("event_time"), F.lit(available_at).alias("available_at"))
    n, digest = rows_digest(rows, ["product_id", "payload_hash"])
    return outbox, {"activation_id": own, "source_version": version, "expected_count": n, "manifest_hash": hashlib.sha256(f"{version}\0{digest}".encode()).hexdigest()}


def activation_gaps(outbox: DataFrame, history: DataFrame, activation: dict) -> DataFrame:
    """What keeps a version from being activated, a row each: events not in history (event_id), events there with another
    payload, and a number of events that isn't the expected one. No row: it can be activated."""
    mine = outbox.where(F.col("activation_id") == activation["activation_id"]).select("event_id", "payload_hash")
    there = history.select(F.col("event_id"), F.col("payload_hash").alias("other")).dropDuplicates(["event_id", "other"])
    met = mine.join(there.groupBy("event_id").agg(F.collect_set("other").alias("others")), "event_id", "left")  # versions of one event
    lost = met.where("others is null").select("event_id", F.lit("missing").alias("reason"))
    other = met.where("others is not null and not array_contains(others, payload_hash)").select("event_id", F.lit("other_payload").alias("reason"))
    count = mine.agg(F.count("*").alias("n")).where(F.col("n") != activation["expected_count"]).select(F.lit(None).cast("string").alias("event_id"), F.lit("count").alias("reason"))
    return lost.unionByName(other).unionByName(count)
