"""Histories before each observation, as a model reads them: products, times and ids of the last events of each action."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fxlake.operators.windows import POSITIVE

DAY = 86400


def _running_count(df: DataFrame, keys: list[str], at: str, place: list[str], flags: dict[str, str]) -> DataFrame:
    """Add, for each name in flags, the sum of that column over the rows of the keys up to this one by (at, *place). Two
    levels: inside a day, and the days before it, so no key is one task."""
    days = df.withColumn("__day", F.floor(F.col(at) / DAY))
    here = [*keys, "__day"]
    inside = Window.partitionBy(here).orderBy(at, *place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    totals = days.groupBy(here).agg(*[F.sum(c).alias(f"__{n}") for n, c in flags.items()])
    totals = totals.select(*here, *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in flags])
    counted = days.select("*", *[F.sum(c).over(inside).alias(f"__own_{n}") for n, c in flags.items()])
    same = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in here])
    joined = counted.alias("l").join(totals.alias("r"), same)
    return joined.select(*[f"l.{c}" for c in df.columns], *[(F.col(f"__own_{n}") + F.col(f"r.__{n}")).alias(n) for n in flags])


def behavior_sequences(observations: DataFrame, events: DataFrame, n: int = 60, days: int = 30) -> DataFrame:
    """For each observation and positive action the last n events, left-padded to n: product_ids ('' in padding), event_times
    (0), event_ids (null), mask (0 or 1).

    An event counts if it happened in the `days` before the observation, strictly before it, and was available by then.
    No observation meets all of its user's events: events are numbered, an ordered pass over both counts those before an
    observation and those of them that can be seen, and only the blocks of n events that hold the last n seen are joined.
    """
    keys = ["user_id", "action"]
    e = events.where(F.col("action").isin(*POSITIVE) & F.col("user_id").isNotNull() & (F.trim(F.coalesce("product_id", F.lit(""))) != ""))
    e = e.select(*keys, "product_id", "event_time", F.coalesce("available_at", "event_time").alias("available_at"), F.coalesce("event_id", F.lit("")).alias("event_id"), F.lit(1).alias("one"))
    e = _running_count(e, keys, "event_time", ["event_id", "product_id"], {"i": "one"}).withColumn("i", F.col("i") - 1)
    o = observations.select("observation_id", "user_id", "as_of")
    each = o.withColumn("action", F.explode(F.array(*map(F.lit, POSITIVE))))

    def before(seen_at: Column, order: Column, name: str) -> DataFrame:
        """Events whose (seen_at, order) is below an observation's (as_of, 1)."""
        none = F.lit(None).cast(observations.schema["observation_id"].dataType)
        rows = each.select(*keys, F.col("as_of").alias("t"), F.lit(1).alias("order"), "observation_id", F.lit(0).alias("event"))
        rows = rows.unionByName(e.select(*keys, seen_at.alias("t"), order.alias("order"), none.alias("observation_id"), F.lit(1).alias("event")))
        return _running_count(rows, keys, "t", ["order", "event"], {name: "event"}).where("event = 0").select("observation_id", "action", name)

    happened = before(F.col("event_time"), F.lit(2), "c")
    late = F.col("available_at") > F.col("event_time")  # seen from available_at on; else after event_time
    seen = before(F.greatest("event_time", "available_at"), F.when(late, 0).otherwise(2), "v")
    span = each.join(happened, ["observation_id", "action"]).join(seen, ["observation_id", "action"]).where("v > 0")
    low = F.greatest(F.lit(0).cast("long"), F.col("v") - n)  # of c events before, c - v aren't seen, so the last n seen are among the last n + c - v
    block = lambda i: F.floor(i / n)
    wide = span.withColumn("low", low).withColumn("block", F.explode(F.sequence(block(F.col("low")), block(F.col("c") - 1))))
    found = wide.join(e.select(*keys, "i", "product_id", "event_time", "available_at", "event_id", block(F.col("i")).alias("block")), [*keys, "block"])
    found = found.where((F.col("i") >= F.col("low")) & (F.col("i") < F.col("c")) & (F.col("available_at") <= F.col("as_of")) & (F.col("event_time") >= F.col("as_of") - DAY * days))
    newest = Window.partitionBy("observation_id", "action").orderBy(F.desc("i"))
    last = found.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= n)
    last = last.groupBy("observation_id", "action").agg(F.sort_array(F.collect_list(F.struct("i", "product_id", "event_time", "event_id"))).alias("s"))
    out = each.join(last, ["observation_id", "action"], "left")
    size = F.coalesce(F.array_size("s"), F.lit(0))

    def padded(value: Column, kind: str, read) -> Column:
        return F.concat(F.array_repeat(value.cast(kind), n - size), F.coalesce(F.transform("s", read), F.array().cast(f"array<{kind}>")))

    return out.select(
        "observation_id", "action", "as_of", padded(F.lit(""), "string", lambda x: x["product_id"]).alias("product_ids"), padded(F.lit(0.0), "double", lambda x: x["event_time"]).alias("event_times"),
        padded(F.lit(None), "string", lambda x: F.nullif(x["event_id"], F.lit(""))).alias("event_ids"), padded(F.lit(0), "int", lambda x: F.lit(1)).alias("mask"),
    )


def check_behavior_sequences(sequences: DataFrame, n: int = 60, days: int = 30) -> DataFrame:
    """Rows that break the contract, with the first reason: known action, lengths, mask, padding on the left, times inside the
    window before as_of, events in order."""
    steps = lambda c: F.arrays_zip(F.slice(F.col(c), 1, n - 1).alias("a"), F.slice(F.col(c), 2, n - 1).alias("b"))
    lengths = reduce(Column.__or__, [F.size(c) != n for c in ("product_ids", "event_times", "event_ids", "mask")])
    real = F.filter(F.arrays_zip("event_times", "mask"), lambda x: x["mask"] == 1)
    times = F.transform(real, lambda x: x["event_times"])
    reason = F.coalesce(
        F.when(~F.coalesce(F.col("action").isin(*POSITIVE), F.lit(False)), "unknown_action"),
        F.when(F.coalesce(lengths, F.lit(True)), "wrong_length"),
        F.when(~F.forall("mask", lambda m: F.coalesce(m.isin(0, 1), F.lit(False))), "mask_not_binary"),
        F.when(F.exists(steps("mask"), lambda x: x["a"] > x["b"]), "not_left_padded"),
        F.when(~F.forall(F.arrays_zip("product_ids", "mask"), lambda x: (F.coalesce(x["product_ids"], F.lit("")) == "") == (x["mask"] == 0)), "mask_mismatch"),
        F.when(F.exists(F.arrays_zip("event_times", "event_ids", "mask"), lambda x: (x["mask"] == 0) & ((F.coalesce(x["event_times"], F.lit(-1.0)) != 0) | x["event_ids"].isNotNull())), "padding_not_empty"),
        F.when(F.exists(times, lambda t: F.coalesce((t >= F.col("as_of")) | (t < F.col("as_of") - DAY * days), F.lit(True))), "outside_window"),
        F.when(F.exists(F.zip_with(F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: a > b), lambda x: x), "not_in_order"),
    )
    return sequences.withColumn("error", reason).where("error is not null")


def sequence_inputs(observations: DataFrame, sequences: DataFrame, index: DataFrame, n: int = 60) -> DataFrame:
    """Numbers that an attention model reads, for each observation: candidate (dense id, 0 if unknown), and for each action in
    the order of POSITIVE an array of n ids, days since each event as log1p, whether the id is known - plus `summary`, four
    values an action: events, known part, least recency, whether there are any; all zeros for an unknown candidate.

    observations have observation_id, product_id, as_of; `index` has product_id and item (from 1). Places of a history are
    carried through the lookup, so the order of rows after the join doesn't matter.
    """
    ids = index.select("product_id", F.col("item").cast("long").alias("item"))
    places = sequences.select("observation_id", "action", "as_of", F.posexplode(F.arrays_zip("product_ids", "event_times", "mask")).alias("place", "x")).where("x.mask = 1")
    known = places.select("observation_id", "action", "place", F.col("x.product_ids").alias("product_id"), F.log1p(F.greatest(F.lit(0.0), F.col("as_of") - F.col("x.event_times")) / DAY).alias("recency"))
    known = known.join(ids, "product_id", "left").withColumn("item", F.coalesce("item", F.lit(0)))
    entry = F.map_from_entries(F.collect_list(F.struct("place", F.struct("item", "recency"))))  # n places at most
    by_action = known.groupBy("observation_id", "action").agg(entry.alias("m"), F.count("*").cast("double").alias("n"), F.count_if(F.col("item") > 0).alias("k"), F.min(F.when(F.col("item") > 0, F.col("recency"))).alias("least"))
    own = F.map_from_entries(F.collect_list(F.struct("action", F.struct("m", "n", "k", "least"))))  # an entry for each action
    request = by_action.groupBy("observation_id").agg(own.alias("h"))
    rows = observations.select("observation_id", "product_id").join(ids, "product_id", "left").select("observation_id", F.coalesce("item", F.lit(0)).alias("candidate")).join(request, "observation_id", "left")
    of = {a: F.element_at("h", a) for a in POSITIVE}
    at = F.sequence(F.lit(0), F.lit(n - 1))
    item = lambda a: F.transform(at, lambda p: F.coalesce(F.element_at(of[a]["m"], p)["item"], F.lit(0).cast("long")))
    recency = lambda a: F.transform(at, lambda p: F.when(F.element_at(of[a]["m"], p)["item"] > 0, F.element_at(of[a]["m"], p)["recency"]).otherwise(0.0))
    zero = F.lit(0.0)
    summary = []
    for a in POSITIVE:
        count = F.coalesce(of[a]["n"], zero)
        summary += [count, F.coalesce(of[a]["k"] / of[a]["n"], zero), F.coalesce(of[a]["least"], zero), F.when(count > 0, 1.0).otherwise(0.0)]
    out = rows.select(
        "observation_id", "candidate", F.array(*map(item, POSITIVE)).alias("items"), F.array(*map(recency, POSITIVE)).alias("recency"),
        F.transform(F.array(*summary), lambda x: F.when(F.col("candidate") > 0, x).otherwise(0.0)).alias("summary"),
    )
    return out.withColumn("known", F.transform("items", lambda row: F.transform(row, lambda x: x > 0)))
