"""Sharding by rendezvous hashing: every record goes to the shard that bids highest for its key.

A shard of weight w bids -w / ln(u) for a key, where u in (0, 1) is read off the first 52 bits of MD5(key:shard). A bid
depends on nothing but key and shard, so a shard that is added takes records only into itself, one that is removed
gives up only its own, and a changed weight moves records to or from that shard alone. Shards get records in proportion
to their weights. The cost is one hash a record and shard.

Records of a shard are numbered without gaps by key, then size and checksum (`ordering.numbered`: no shard is one
task). A hot key goes to one shard, as it must, but to as many tasks and files as its rows need.

Defined results: a null key is the empty string (a null doc_id shares the empty key); a null text has no bytes and checksum 0. Repeated
rows keep a slot each. Weights must be positive and finite. An empty table gives an empty result. `assign` keeps all
columns and refuses a table that has one of the names it adds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fxlake.llm.common import materialize, read_table
from fxlake.llm.ordering import numbered

SHARDS = 40
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def bid(key: Column, shard: Column, weight: Column) -> Column:
    """The shard's bid for the key; 2^52 values of u, none of them 0 or 1."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, shard.cast("string"))), 1, 13), 16, 10).cast("long")
    return -weight / F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52)))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """struct(bid, shard) of the shard with the highest bid; of equal bids that of the lower shard."""
    if not weights or not all(0 < w < float("inf") for w in weights):
        raise ValueError("weights must be positive and finite, and at least one")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    bids = F.transform(shards, lambda s: F.struct(bid(key, s["shard"], s["weight"]).alias("bid"), (-s["shard"]).alias("minus")))
    best = F.array_max(bids)
    return F.struct(best["bid"].alias("bid"), (-best["minus"]).alias("shard"))


def assign(df: DataFrame, key: str, weights: Sequence[float], grown: float | None = None, out: str = "shard") -> DataFrame:
    """Add each record's shard and, with the weight of one more shard, the shard it would then have (grown_<out>)."""
    added = [out, f"grown_{out}"] if grown is not None else [out]
    if taken := [c for c in added if c.lower() in {x.lower() for x in df.columns}]:
        raise ValueError(f"columns already there: {taken}")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    found = df.withColumn("__won", winner(text, weights))
    shard = F.col("__won.shard")
    if grown is not None:
        more = F.lit(len(weights))
        found = found.withColumn(f"grown_{out}", F.when(bid(text, more, F.lit(float(grown))) > F.col("__won.bid"), more).otherwise(shard))
    return found.withColumn(out, shard).select(*df.columns, *added)


def slots(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Add each record's place in its shard, from 0 without gaps."""
    return numbered(df, [shard], [F.col(c).asc_nulls_first() for c in order], out, "shard-slots")


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot", rows_a_file: int = 1 << 20) -> None:
    """Write a folder for each shard, in files of consecutive slots. A large shard is written by many tasks."""
    part = F.floor(F.col(slot) / rows_a_file)
    df.withColumn("__part", part).repartition(shard, "__part").drop("__part").sortWithinPartitions(shard, slot).write.partitionBy(shard).option("maxRecordsPerFile", rows_a_file).parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document: 40 shards of equal weight, and 41."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = materialize(assign(docs, "doc_id", [1.0] * SHARDS, 1.0), "shards")
    return slots(placed, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 by its table of 256 remainders, built by rule; bytes are read off the hexadecimal form of the text.
OP12_SQL = """
with recursive remainders(i, step, r) as (
    select i, 0, i::bigint from range(256) t(i)
    union all
    select i, step + 1, case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end from remainders where step < 8
), crc_table as (select list(r order by i) as t from remainders where step = 8),
docs as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
bytes as (select n, doc_id, strlen(text) as len, hex(encode(text)) as hex from docs),
crc as (
    select n, doc_id, len + 16 as size,
           xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len), lambda i: ('0x' || substr(hex, (2 * i + 1)::bigint, 2))::bigint)),
                           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::bigint) as text_crc32
    from bytes, crc_table
), bids as (
    select n, s, -1.0::double / ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || s::varchar), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double) as bid
    from docs, range(41) t(s)
), won as (
    select n, arg_max(s, bid) filter (s < 40) as shard, arg_max(s, bid) as grown_shard from bids group by n
)
select doc_id, size::bigint as size, text_crc32, 'key' as law, shard::integer as shard,
       row_number() over (partition by shard order by doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard::integer as grown_shard
from crc join won using (n)
"""
