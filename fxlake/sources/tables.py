"""Sinks and table maintenance over Parquet folders; CSV loaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fxlake.sources import files


def append_once(new: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` to append: one for each key that the target doesn't have."""
    return new.dropDuplicates(keys).join(target.select(*keys).distinct(), keys, "left_anti")


def upsert_latest(target: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The target after an upsert: the row of the highest version of each key; equal versions: the new row."""
    both = target.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def write_monthly(events: DataFrame, path: str, ts: str = "event_ts", rows_per_file: int = 5_000_000) -> None:
    """Partitions by month of the event. A month has as many files as its counted rows need, so neither a task nor a file
    grows with the table. Rows without a time go to the default partition."""
    month = F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(""))
    files = events.groupBy(month.alias("month")).agg(F.ceil(F.count("*") / rows_per_file).alias("__files"))
    # files are numbered through, so that each is one task; hashed, several of them would meet in a task
    first = F.coalesce(F.sum("__files").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("month", "__files", first.alias("__first"))
    rows = events.withColumn("month", month).join(F.broadcast(files), "month")  # a row a month
    number = (F.col("__first") + F.pmod(F.xxhash64("event_id"), F.col("__files"))).cast("int")
    total = files.agg(F.sum("__files")).first()[0] or 1
    rows = rows.repartitionById(int(total), number).drop("__files", "__first")
    rows.withColumn("month", F.nullif("month", F.lit(""))).write.mode("overwrite").partitionBy("month").parquet(path)


def prune(df: DataFrame, ts: str, now: float, days: int) -> DataFrame:
    return df.where(F.col(ts) >= now - 86400 * days)


def evolve_additive(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """The target's columns in its order; missing ones are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns])


def run_once(spark: SparkSession, path: str, run_id: str, build) -> DataFrame:
    """Write build() under its run id unless the run has ended before; read the run back. A folder without the mark of an
    ended job is what a broken run has left: it is written anew."""
    target = f"{path}/run_id={run_id}"
    if not files.exists(spark, f"{target}/_SUCCESS"):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def load_interactions(rows: DataFrame) -> DataFrame:
    """Boolean columns -> one action: purchase, add_to_cart, favorite, share, click (comment or half watched), view."""
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    action: Column = (
        F.when(yes("purchased"), "purchase").when(yes("added_to_cart"), "add_to_cart").when(yes("liked"), "favorite").when(yes("shared"), "share")
        .when(yes("commented") | (F.col("watch_percentage").cast("double") > 0.5), "click").otherwise("view")
    )
    return rows.select("user_id", "product_id", action.alias("action"), F.when(yes("purchased"), F.col("purchase_amount").cast("double")).alias("value"))


def rollup_loaded_users(users: DataFrame, interactions: DataFrame) -> DataFrame:
    per = interactions.groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("product_category")).alias("categories"), F.max("event_time").alias("last_active"))
    return users.join(per, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("total_interactions"), F.coalesce(F.array_join("categories", ","), F.lit("")).alias("categories"), "last_active")
