"""Sealed training sets: immutable shards, a manifest that is created once, a pointer that moves only forward, and a read
that trusts nothing which it hasn't checked.

A run writes its rows under runs/<run>/attempts/<n>/shards and is published by runs/<run>/manifest.json. The manifest is
small whatever the size of the set: digests of the shards are a table beside it, made by tasks, and the manifest holds a
digest of that table which doesn't depend on the order of its rows. latest.json names the run with the latest cutoff.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fxlake.functions.contracts import bundle_sha256
from fxlake.sources import files

#: What a shard must have.
REQUIRED = (
    "observation_id", "impression_id", "user_id", "product_id", "as_of_ts", "user_features_json", "product_metadata_json", "context_json", "candidate_features_json",
    "online_feature_bundle_hash", "feature_bundle_hash", "attributed_action", "attributed_click", "attributed_purchase", "attributed_value", "attributed_value_source",
    "feature_definition_version", "label_definition_version",
)
SCORES = ("collaborative_score", "content_similarity_score", "popularity_score", "combined_score")
#: Bytes of behaviour sequences that a row may have.
MOST_SEQUENCE_BYTES = 512_000
SHARD_BYTES = 128 << 20


class SealedSetError(ValueError):
    """The set can't be published, or must not be read."""


class SealedSetMissing(SealedSetError):
    """Nothing has been published."""


def rows_digest(df: DataFrame, columns: list[str] | None = None) -> tuple[int, str]:
    """Number of rows and a digest that is the same for the same rows in any order and partitioning, repeated rows counted.

    Each row's SHA-256 is cut into eight numbers of 32 bits, which tasks add up; the digest is the SHA-256 of the sums.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring("__sha", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{i}") for i in range(8)]
    n, *sums = df.select(row.alias("__sha")).agg(F.count("*").alias("n"), *parts).first()
    return n, hashlib.sha256(":".join([str(n), *(s or "0" for s in sums)]).encode()).hexdigest()


def schema_hash(schema: StructType) -> str:
    return hashlib.sha256(schema.simpleString().encode()).hexdigest()


def shards_folder(prefix: str, run: str, attempt: int) -> str:
    if not run.strip() or "/" in run or attempt < 1:
        raise SealedSetError("a run needs a name without slashes and an attempt of 1 or more")
    return f"{prefix.rstrip('/')}/runs/{run}/attempts/{attempt}/shards"


def export_shards(df: DataFrame, prefix: str, run: str, attempt: int = 1, rows_a_shard: int = 0) -> str:
    """Write the rows as the shards of an attempt, about SHARD_BYTES each; an attempt that is there already is an error."""
    folder = shards_folder(prefix, run, attempt)
    if files.exists(df.sparkSession, folder):
        raise SealedSetError(f"attempt {attempt} of run {run} exists")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark, before = df.sparkSession, df.sparkSession.conf.get(key, None)
    spark.conf.set(key, str(SHARD_BYTES))
    try:
        df.hint("rebalance").write.mode("errorifexists").option("maxRecordsPerFile", rows_a_shard).parquet(folder)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return folder


def shard_digests(spark: SparkSession, folder: str) -> DataFrame:
    """shard (path under runs/), byte_size, sha256 of each shard. A task holds one shard at a time."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return found.select(F.regexp_extract("path", r"/(runs/[^/]+/attempts/.*)$", 1).alias("shard"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All shards. Their footers are merged, so a shard with a column of its own changes the schema's hash."""
    return spark.read.option("mergeSchema", True).option("pathGlobFilter", "part-*").parquet(folder)


def publish(
    spark: SparkSession, prefix: str, run: str, attempt: int, *, table: str, snapshot: str, feature_version: str, label_version: str, cutoff: float, quarantined: int = 0, expected_rows: int | None = None,
) -> str:
    """Check an attempt's shards, write the run's manifest unless it is there, and move the pointer. Returns the pointer's path.

    The same call again changes nothing; another attempt of a published run is an error, as its shards are others.
    """
    folder = shards_folder(prefix, run, attempt)
    if not files.exists(spark, folder):
        raise SealedSetError("no shards to publish")
    rows = read_shards(spark, folder)
    if lost := [c for c in REQUIRED if c not in rows.columns]:
        raise SealedSetError(f"shards lack {lost}")
    equal = lambda c, v: F.col(c).eqNullSafe(F.lit(v))
    stats = rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("online_feature_bundle_hash") == F.col("feature_bundle_hash")).alias("same"), F.min("as_of_ts").alias("low"), F.max("as_of_ts").alias("high"),
        F.count_if(~equal("feature_definition_version", feature_version)).alias("feature"), F.count_if(~equal("label_definition_version", label_version)).alias("label"),
    ).first()
    if not stats["rows"]:
        raise SealedSetError("no rows to publish")
    if stats["feature"] or stats["label"]:
        raise SealedSetError(f"rows of other versions: {stats['feature']} of features, {stats['label']} of labels")
    if expected_rows is not None and expected_rows != stats["rows"]:
        raise SealedSetError(f"{stats['rows']} rows, expected {expected_rows}")
    listed = f"{prefix.rstrip('/')}/runs/{run}/attempts/{attempt}/shard-list"
    if not files.exists(spark, f"{listed}/_SUCCESS"):
        shard_digests(spark, folder).write.mode("overwrite").parquet(listed)
    shards, digest = rows_digest(spark.read.parquet(listed))
    total = spark.read.parquet(listed).agg(F.sum("byte_size")).first()[0]
    manifest = {
        "status": "complete", "dataset_version": f"snapshot-{snapshot}", "materialization_run_id": run, "attempt": attempt, "table_id": table, "snapshot_id": str(snapshot),
        "feature_definition_version": feature_version, "label_definition_version": label_version, "schema": rows.schema.jsonValue(), "schema_hash": schema_hash(rows.schema), "attribution_cutoff": float(cutoff),
        "row_count": stats["rows"], "quarantine_row_count": max(0, quarantined), "online_offline_parity_ratio": stats["same"] / stats["rows"],
        "min_as_of_ts": stats["low"], "max_as_of_ts": stats["high"], "shard_count": shards, "byte_size": total, "shards_digest": digest,
    }
    path = f"{prefix.rstrip('/')}/runs/{run}/manifest.json"
    if not files.write_json(spark, path, manifest) and files.read_json(spark, path) != manifest:
        raise SealedSetError(f"run {run} has another manifest already")
    return move_pointer(spark, prefix, run, cutoff)


def move_pointer(spark: SparkSession, prefix: str, run: str, cutoff: float) -> str:
    """Point latest.json to the run unless it names a later cutoff; the same cutoff of another run is an error."""
    path = f"{prefix.rstrip('/')}/latest.json"
    now = files.read_json(spark, path)
    if now is not None and now["attribution_cutoff"] > cutoff:
        return path
    if now is not None and now["attribution_cutoff"] == cutoff and now["materialization_run_id"] != run:
        raise SealedSetError(f"run {now['materialization_run_id']} has this cutoff already")
    files.write_json(spark, path, {"manifest": f"runs/{run}/manifest.json", "materialization_run_id": run, "attribution_cutoff": float(cutoff)}, replace=True)
    return path


def row_faults(rows: DataFrame, feature_version: str, label_version: str) -> DataFrame:
    """rows with `fault`: why a row can't be trained on, null for good rows. The bundle's hash is computed anew."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    no_object = lambda c: ~F.coalesce(F.to_json(F.try_parse_json(c)).startswith("{"), F.lit(False))
    empty = lambda c: F.to_json(F.try_parse_json(c)) == "{}"
    no_number = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json("candidate_features_json"), f"$.{c}", "double").isNull(), F.lit(True))
    sequences = F.col("behavior_sequences_json") if "behavior_sequences_json" in rows.columns else F.lit(None).cast("string")
    own = bundle_sha256(*[F.col(c) for c in ("as_of_ts", "user_id", "product_id", "user_features_json", "product_metadata_json", "context_json", "candidate_features_json", "feature_definition_version")], sequences=sequences)
    checks: list[tuple[Column, str]] = [
        (F.col("as_of_ts").isNull(), "missing_as_of_ts"),
        (F.length(F.coalesce("feature_bundle_hash", F.lit(""))) != 64, "missing_feature_bundle_hash"),
        (F.length(F.coalesce("online_feature_bundle_hash", F.lit(""))) != 64, "missing_online_feature_bundle_hash"),
        (~F.col("feature_definition_version").eqNullSafe(F.lit(feature_version)), "feature_definition_version"),
        (~F.col("label_definition_version").eqNullSafe(F.lit(label_version)), "label_definition_version"),
        (F.octet_length(F.coalesce(sequences, F.lit(""))) > MOST_SEQUENCE_BYTES, "oversized_behavior_sequences"),
        *[(no_object(c), f"invalid_{c}") for c in ("user_features_json", "product_metadata_json", "context_json", "candidate_features_json")],
        (~F.col("feature_bundle_hash").eqNullSafe(F.col("__own")), "feature_bundle_hash"),
        (reduce(Column.__or__, map(blank, ("impression_id", "observation_id", "user_id", "product_id"))), "missing_ids"),
        (empty("user_features_json"), "missing_user_features"),
        (empty("product_metadata_json"), "missing_product_metadata"),
        (reduce(Column.__or__, map(no_number, SCORES)), "missing_candidate_scores"),
    ]
    fault = F.coalesce(*[F.when(bad, F.lit(reason)) for bad, reason in checks])
    return rows.withColumn("__own", own).withColumn("fault", fault).drop("__own")


def read_sealed(spark: SparkSession, latest: str, feature_version: str, label_version: str) -> tuple[DataFrame, dict]:
    """The rows that the pointer leads to, and their manifest. Pointer, manifest, each shard's bytes, the schema, the number
    of rows and every row are checked before anything is returned; a single fault fails the whole read."""
    try:
        pointer = files.read_json(spark, latest)
        if pointer is None:
            raise SealedSetMissing(f"nothing is published at {latest}")
        prefix = latest.rsplit("/", 1)[0]
        run = pointer.get("materialization_run_id")
        manifest = files.read_json(spark, f"{prefix}/{pointer.get('manifest')}") if run and pointer.get("manifest") else None
    except SealedSetMissing:
        raise
    except ValueError as error:
        raise SealedSetError(f"unreadable: {error}") from error
    if manifest is None:
        raise SealedSetError("the pointer leads to no manifest")
    wanted = {"status": "complete", "materialization_run_id": run, "feature_definition_version": feature_version, "label_definition_version": label_version}
    if wrong := [k for k, v in wanted.items() if manifest.get(k) != v]:
        raise SealedSetError(f"manifest: other {wrong}")
    if lost := [k for k in ("dataset_version", "table_id", "snapshot_id", "schema_hash", "shards_digest", "shard_count", "row_count", "schema", "attempt") if not manifest.get(k)]:
        raise SealedSetError(f"manifest without {lost}")
    folder = shards_folder(prefix, run, manifest["attempt"])
    listed = f"{folder.removesuffix('/shards')}/shard-list"
    if not files.exists(spark, folder) or not files.exists(spark, listed):
        raise SealedSetError("shards or their list are missing")
    listing = spark.read.parquet(listed)
    if rows_digest(listing) != (manifest["shard_count"], manifest["shards_digest"]):
        raise SealedSetError("the list of shards has changed")
    there = shard_digests(spark, folder)
    odd = there.join(listing, ["shard", "byte_size", "sha256"], "left_anti").select("shard").unionByName(listing.join(there, ["shard", "byte_size", "sha256"], "left_anti").select("shard")).distinct()
    if names := sorted(r["shard"] for r in odd.limit(10).collect()):  # some names for the message; one is enough to fail
        raise SealedSetError(f"missing, added or changed shards: {names}")
    if schema_hash(read_shards(spark, folder).schema) != manifest["schema_hash"]:
        raise SealedSetError("other schema")
    rows = spark.read.schema(StructType.fromJson(manifest["schema"])).option("pathGlobFilter", "part-*").parquet(folder)
    counts = {r["fault"]: r["n"] for r in row_faults(rows, feature_version, label_version).groupBy("fault").agg(F.count("*").alias("n")).collect()}  # one row a reason
    if sum(counts.values()) != manifest["row_count"]:
        raise SealedSetError(f"{sum(counts.values())} rows, the manifest has {manifest['row_count']}")
    if bad := {k: n for k, n in counts.items() if k is not None}:
        raise SealedSetError(f"rows with faults: {bad}")
    return rows, manifest
