"""Positions and running sums inside groups of any size, so that no group lands in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fxlake.llm.common import materialize

#: Rows of a group that one task adds up where places are known.
BLOCK = 1024


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str, name: str) -> DataFrame:
    """Add each row's position in its group, from 0 in `order`; equal rows get some order among themselves.

    Ranges of (group, order) are dealt to tasks, so a large group spans many; rows are counted by range, and a range's
    first position is the sum of the group's earlier ranges. The ranges are written before they are read twice: a range
    is what lies in the files, whatever executor is lost. `df` should be a stored table (it is read twice).
    """
    placed = df.withColumn("__row", F.monotonically_increasing_id())
    placed = materialize(placed.repartitionByRange(*group, *order, "__row").withColumn("__range", F.spark_partition_id()), name)
    here = ["__range", *group]
    counts = placed.groupBy(here).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).where("__start > 0").select(*here, "__start")
    rows = placed.withColumn("__at", F.row_number().over(Window.partitionBy(here).orderBy(*order, "__row")))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in here]
    found = rows.alias("l").join(starts.alias("r"), same, "left")
    return found.select(*[f"l.{c}" for c in df.columns], (F.coalesce("__start", F.lit(0)) + F.col("__at") - 1).cast("long").alias(out))


def running(df: DataFrame, group: list[str], place: str, sums: list[str], backwards: bool = False) -> DataFrame:
    """Replace the columns `sums` by their running sums over the dense positions `place` of a group (from the end if
    backwards). A group is added up in blocks of BLOCK positions; the sums of earlier blocks are added to each."""
    block = F.floor(F.col(place) / BLOCK) * (-1 if backwards else 1)
    order = F.col(place).desc() if backwards else F.col(place).asc()
    blocks = df.withColumn("__block", block)
    here = [*group, "__block"]
    inside = Window.partitionBy(here).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = blocks.groupBy(here).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*here, F.row_number().over(Window.partitionBy(group).orderBy("__block")).alias("__k"), *[F.sum(f"__{c}").over(before).alias(f"__{c}") for c in sums])
    earlier = earlier.where("__k > 1").drop("__k")  # most groups have one block
    out = blocks.select(*[c for c in blocks.columns if c not in sums], *[F.sum(c).over(inside).alias(c) for c in sums]).join(earlier, here, "left")
    return out.select(*[c for c in df.columns if c not in sums], *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums])
