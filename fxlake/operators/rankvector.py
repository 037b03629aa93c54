"""The parts of the ranking vector beyond the base values: last-n histories and sliding windows of each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fxlake.operators import pit as P
from fxlake.operators.candidates import dot
from fxlake.operators.features import ACTION_SCALE, last_positive
from fxlake.operators.windows import POSITIVE, WINDOWS, safe_ratio, slide_counts, slide_seconds

ENTITIES = ("user", "product", "category")
#: Vectors are broadcast up to this many numbers, and joined by a shuffle above.
BROADCAST_NUMBERS = 4 << 20
COUNTS, RATIOS = ("views", "clicks", "add_to_carts", "purchases"), ("click_through_rate", "conversion_rate")


def _floats(parts: list[Column]) -> Column:
    zero = F.lit(0.0).cast("float")
    return F.transform(F.array(*[p.cast("float") for p in parts]), lambda x: F.nanvl(F.coalesce(x, zero), zero))


def history_block(rows: DataFrame, events: DataFrame, embeddings: DataFrame, dim: int, n: int = 20, most_days: float = 30.0) -> DataFrame:
    """(row_id, history): for click, add_to_cart and purchase, in this order, dim + 5 numbers: the scaled mean of the vectors
    of the last n earlier products, n's share that there is, the share of these that have a vector, days since the last one
    (at most `most_days`, also where there is none), whether there is a vector, and the mean's dot product with the row's product.

    rows: row_id, user_id, product_id, as_of. Every row has a block. Vectors of another length don't count; NaN is 0.
    A row and action gathers at most n vectors, where the row is: what is shuffled are the products' ids and not their
    vectors, or, with more than BROADCAST_NUMBERS numbers, each vector once.
    """
    vectors = embeddings.where(F.size("vector") == dim).select(F.col("product_id").alias("past"), F.transform("vector", lambda x: F.nanvl(x.cast("double"), F.lit(0.0))).alias("v"))
    small, near = vectors.count() * dim <= BROADCAST_NUMBERS, last_positive(rows, events, n)
    # both groupings find their rows together then
    near = near.repartition("row_id").join(F.broadcast(vectors), "past", "left") if small else near.join(vectors, "past", "left").repartition("row_id")
    kept = near.groupBy("row_id", "action").agg(F.count("*").alias("k"), F.max("event_time").alias("latest"), F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("i", "v")))).alias("vs"))
    blocks = kept.groupBy("row_id").agg(*[F.first(F.when(F.col("action") == a, F.struct("k", "latest", "vs")), ignorenulls=True).alias(a) for a in POSITIVE])
    zeros = F.array_repeat(F.lit(0.0), dim)
    own = vectors.withColumnRenamed("v", "__own")
    out = rows.select("row_id", "as_of", F.col("product_id").alias("past"))
    out = out.join(blocks, "row_id", "left").join(F.broadcast(own), "past", "left") if small else out.join(own, "past", "left").join(blocks, "row_id", "left")
    for a in POSITIVE:
        total = F.aggregate(F.col(a)["vs"], zeros, lambda s, x: F.zip_with(s, x["v"], lambda p, q: p + q))
        covered = F.array_size(F.col(a)["vs"])
        out = out.withColumn(f"{a}_mean", F.when(covered > 0, F.transform(total, lambda x: x / covered * ACTION_SCALE[a])).otherwise(zeros))  # noqa: B023
    numbers = []
    for a in POSITIVE:
        k, covered = F.coalesce(F.col(a)["k"], F.lit(0)), F.coalesce(F.array_size(F.col(a)["vs"]), F.lit(0))
        latest = F.col(a)["latest"]
        days = F.when(latest.isNull(), F.lit(most_days)).otherwise(F.least(F.greatest((F.col("as_of") - latest) / 86400, F.lit(0.0)), F.lit(most_days)))
        rest = [k / n, F.when(k > 0, covered / k).otherwise(0.0), days, F.when(covered > 0, 1.0).otherwise(0.0), dot(F.col(f"{a}_mean"), F.col("__own"))]
        numbers += [F.col(f"{a}_mean").cast("array<float>"), _floats(rest)]
    return out.select("row_id", F.concat(*numbers).alias("history"))


def window_block(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(row_id, windows): for user, product and category, in windows of 5 minutes, an hour and a day: four counts in
    thousands and two rates, of the latest window that had ended by the row's time. No such window, or no entity: zeros.

    rows: row_id, user_id, product_id, category, as_of; windows as `all_window_features` gives them. All nine are looked up
    by one as-of pass over (entity, window), which spreads hot entities over days.
    """
    slots = [(e, w) for e in ENTITIES for w in WINDOWS]
    ids = {"user": "user_id", "product": "product_id", "category": "category"}
    key = lambda entity, window, name: F.concat_ws("|", entity, window, name)
    asked = F.array(*[F.when(F.coalesce(F.col(ids[e]), F.lit("")) != "", F.struct(F.lit(i).alias("slot"), key(F.lit(e), F.lit(w), F.col(ids[e])).alias("key"))) for i, (e, w) in enumerate(slots)])
    rows_by_key = rows.select("row_id", "as_of", F.explode(F.array_compact(asked)).alias("a")).select("row_id", "as_of", "a.slot", "a.key", F.lit("").alias("version"))
    past = windows.select(key("entity_type", "window", "entity_id").alias("key"), F.col("window_end").alias("event_time"), F.col("window_end").alias("available_at"), F.lit("").alias("source_event_id"), F.lit("").alias("version"), *COUNTS, *RATIOS)
    found = P.asof_latest(rows_by_key, past, "key", [*COUNTS, *RATIOS])
    numbers = _floats([*[F.col(c) / 1000 for c in COUNTS], *[F.col(r) for r in RATIOS]])
    return _placed(rows, found, numbers, len(slots))


def window_block_of_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    """`window_block` of the events' windows, without making them: a row looks up the latest slide that had ended by its
    time, with the slides of a window's length up to it (at most 24), and adds up those of the latest window that has some.
    An event gives at most nine slides, where it lies in up to 123 windows."""
    slots = [(e, w) for e in ENTITIES for w in WINDOWS]
    ids = {"user": "user_id", "product": "product_id", "category": "category"}
    key = lambda entity, window, name: F.concat_ws("|", entity, window, name)
    asked = F.array(*[F.when(F.coalesce(F.col(ids[e]), F.lit("")) != "", F.struct(F.lit(i).alias("slot"), key(F.lit(e), F.lit(w), F.col(ids[e])).alias("key"))) for i, (e, w) in enumerate(slots)])
    rows_by_key = rows.select("row_id", "as_of", F.explode(F.array_compact(asked)).alias("a")).select("row_id", "as_of", "a.slot", "a.key", F.lit("").alias("version"))

    def slides_of(name: str) -> DataFrame:
        seconds, length = slide_seconds(name)
        near = Window.partitionBy("entity_type", "entity_id").orderBy("slide").rangeBetween(1 - length, 0)
        end = ((F.col("slide") + 1) * seconds).cast("double")
        own = F.struct("slide", *COUNTS)
        return slide_counts(events, name).select(key(F.col("entity_type"), F.lit(name), F.col("entity_id")).alias("key"), end.alias("event_time"), end.alias("available_at"), F.lit("").alias("source_event_id"), F.lit("").alias("version"), "slide", F.collect_list(own).over(near).alias("near"))

    found = P.asof_latest(rows_by_key, reduce(DataFrame.unionByName, map(slides_of, WINDOWS)), "key", ["slide", "near"])
    of_slot = lambda i: F.element_at(F.array(*[F.lit(slide_seconds(w)[i]) for _, w in slots]), F.col("slot") + 1)
    # the latest window ends by the row's time, and has the slide in it
    begin = F.least(F.floor(F.floor("as_of") / of_slot(0)), F.col("slide") + of_slot(1)) - of_slot(1)
    found = found.where("slide is not null").withColumn("inside", F.filter("near", lambda x: x["slide"] >= begin))
    found = found.withColumns({c: F.aggregate("inside", F.lit(0).cast("long"), lambda s, x: s + x[c]) for c in COUNTS})  # noqa: B023
    rate = lambda a, b: F.round(safe_ratio(F.col(a), F.col(b)), 6)
    return _placed(rows, found, _floats([*[F.col(c) / 1000 for c in COUNTS], rate("clicks", "views"), rate("purchases", "clicks")]), len(slots))


def _placed(rows: DataFrame, found: DataFrame, numbers: Column, slots: int) -> DataFrame:
    """(row_id, windows): the numbers of each slot in order; zeros where there are none."""
    placed = found.groupBy("row_id").agg(*[F.max(F.when(F.col("slot") == i, numbers)).alias(f"s{i}") for i in range(slots)])
    none = F.array_repeat(F.lit(0.0).cast("float"), len(COUNTS) + len(RATIOS))
    whole = F.concat(*[F.coalesce(f"s{i}", none) for i in range(slots)])
    return rows.select("row_id").join(placed, "row_id", "left").select("row_id", whole.alias("windows"))


def with_blocks(features: DataFrame, *blocks: DataFrame, row_id: str = "observation_id", out: str = "features") -> DataFrame:
    """features with the blocks (row_id, array) behind the vector `out`, in the given order."""
    joined = reduce(lambda left, b: left.join(b.withColumnRenamed("row_id", row_id), row_id), blocks, features)
    names = [next(c for c in b.columns if c != "row_id") for b in blocks]
    return joined.withColumn(out, F.concat(out, *names)).drop(*names)
