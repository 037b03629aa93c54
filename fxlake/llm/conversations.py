"""Conversation prefix trie: what many conversations share from their first turn on.

Identical conversations collapse into one weighted sequence with the list of its conversations ("ends"). Sequences that
are proper prefixes of others drop out by an anti-join; what is left are the leaves. Sums of weights over the prefixes
of all sequences give members, sums over those of leaves give leaves.

A node is named by its depth and the sum of 128-bit hashes of (place, turn) up to it, so a prefix is a running sum and a
conversation of any length spans many tasks; turns are compared by SHA-256 of role and text. Texts are read once and
never shuffled. Sums over a subtree need no pairs of ancestor and node: each node belongs to the least leaf under it, a
leaf's own nodes are the lower end of its path, so a subtree's sum is the running sum up the own path plus the totals of
the subtree's other leaves.

Defined results: rows without a conversation belong to none and are left out; null roles and texts are empty ones; a null
turn comes first; equal turns order by the SHA-256 of role and text, and repeated rows are turns each. A conversation
without turns is a member of the root alone. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.llm.common import bounded_batches, materialize, read_table, release
from fxlake.llm.ordering import BLOCK, numbered, running

NODE = ["depth", "hi", "lo"]
#: Rebuilt conversations start with up to SHARED - 1 turns of the first conversation of their FAMILY.
FAMILY, SHARED = 20, 4
#: Nodes with at least this part of all nodes as children are broadcast: no more than this many.
HOT_PARENTS = 1000
#: Conversations in one piece of an end list.
PIECE = 4096


def ordered_turns(df: DataFrame) -> DataFrame:
    """conv_id, at (from 0), turn_sha256 (of the length of the role, role and text), words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("turn_sha256"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    stored = materialize(turns, "turns")
    out = materialize(numbered(stored, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("turn_sha256")], "at", "turns-ranges"), "turns-numbered")
    release(stored)
    return out.select("conv_id", "at", "turn_sha256", "words")


def turn_texts(df: DataFrame) -> DataFrame:
    """role and text of each turn_sha256, for a join with the trie."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return df.where("conv_id is not null").select(digest.alias("turn_sha256"), role.alias("role"), text.alias("text")).dropDuplicates(["turn_sha256"])


def with_blocks(df: DataFrame, last: str) -> DataFrame:
    """One row for each block of places up to `last`: joins by conversation and block, so a long one spans many tasks."""
    return df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col(last), F.lit(0)) / BLOCK).cast("long"))))


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they stand: the turns with depth and length, and all conversations with their lengths."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    blocks = with_blocks(lengths, "length")
    rows = turns.withColumn("block", F.floor(F.col("at") / BLOCK)).join(blocks, ["conv_id", "block"])
    return rows.select("conv_id", (F.col("at") + 1).alias("depth"), "length", "turn_sha256", "words"), lengths


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As `as_they_are`, of conversations whose first h turns are those of their family's first conversation.

    h is the CRC-32 of the decimal id, mod SHARED; the family of c starts at c - c % FAMILY (the remainder has c's sign).
    """
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < SHARED - 1)).groupBy(F.col("conv_id").alias("first"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("at", "turn_sha256", "words"))).alias("head"))  # SHARED - 1 turns at most
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int"))
    convs = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "first", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    convs = convs.withColumn("k", F.size("head")).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "n", "h", "k", "length", "head"), "rebuilt-heads")
    blocks = with_blocks(convs.select("conv_id", "n", "h", "k", "length"), "n")
    own = turns.withColumn("block", F.floor(F.col("at") / BLOCK)).join(blocks, ["conv_id", "block"]).where("at >= h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("k") + 1).alias("depth"), "length", "turn_sha256", "words")
    shared = convs.select("conv_id", "length", F.posexplode("head").alias("place", "x"))
    shared = shared.select("conv_id", (F.col("place") + 1).cast("long").alias("depth"), "length", "x.turn_sha256", "x.words")
    return own.unionByName(shared), convs.select("conv_id", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with the names of its node and of the node above."""
    parts = ["a", "b", "c", "d"]
    half = F.lit(0xFFFFFFFF).cast("long")
    one, two = (F.xxhash64(F.lit(seed), "depth", "turn_sha256") for seed in (1, 2))
    own = turns.withColumns({"__1": one, "__2": two})
    items = {"a": F.shiftrightunsigned("__1", 32), "b": F.col("__1").bitwiseAND(half), "c": F.shiftrightunsigned("__2", 32), "d": F.col("__2").bitwiseAND(half)}
    own = own.withColumns(items | {f"own_{p}": c for p, c in items.items()}).drop("__1", "__2")  # sums of 32-bit numbers don't overflow
    sums = running(own.withColumn("place", F.col("depth") - 1), ["conv_id"], "place", parts)

    def joined(high, low):
        return F.shiftleft(high.bitwiseAND(half), 32).bitwiseOR(low.bitwiseAND(half))

    above = {p: F.col(p) - F.col(f"own_{p}") for p in parts}
    return sums.select(
        "conv_id", "depth", "length", "turn_sha256", "words", joined(F.col("a"), F.col("b")).alias("hi"), joined(F.col("c"), F.col("d")).alias("lo"),
        joined(above["a"], above["b"]).alias("up_hi"), joined(above["c"], above["d"]).alias("up_lo"),
    )


def end_lists(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ascending conversations of each node that some end at.

    Conversations are sorted by range, joined into pieces, and a node's pieces are hashed one after the other: a task
    holds one piece, and the one that hashes a node's list reads a row for PIECE conversations.
    """
    bounded_batches(ends.sparkSession)

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, held = None, []
        for frame in frames:
            out = []
            for *here, conv in frame[[*NODE, "conv_id"]].itertuples(index=False):
                if held and (here != node or len(held) == PIECE):
                    out.append((*node, held[0], ",".join(map(str, held))))
                    held = []
                node = here
                held.append(conv)
            yield pd.DataFrame(out, columns=[*NODE, "first", "ids"])
        if held:
            yield pd.DataFrame([(*node, held[0], ",".join(map(str, held)))], columns=[*NODE, "first", "ids"])

    def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for frame in frames:
            out = []
            for *here, ids in frame[[*NODE, "ids"]].itertuples(index=False):
                if here == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = here, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    key = "depth bigint, hi bigint, lo bigint"
    sorted_ends = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    listed = sorted_ends.mapInPandas(pieces, f"{key}, first bigint, ids string")
    return listed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInPandas(hashes, f"{key}, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie of conversations, given as (conv_id, depth from 1, length, turn_sha256, words) and (conv_id, length).

    A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and
    turn_sha256 of its last turn (null at the root).
    """
    zero, no_id = F.lit(0).cast("long"), F.lit(None).cast("long")
    prefixes = materialize(_prefixes(turns), "prefixes")
    ends = prefixes.where("depth = length").select("conv_id", *NODE).unionByName(conversations.where("length = 0").select("conv_id", *[zero.alias(c) for c in NODE]))
    ends = materialize(ends, "ends")
    sequences = materialize(ends.groupBy(NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("rep")), "sequences")

    # the paths of whole sequences, the root's row included
    block = F.floor(F.col("depth") / BLOCK)
    steps = prefixes.withColumnRenamed("conv_id", "rep").withColumn("block", block).join(with_blocks(sequences.select("rep", "weight", F.col("depth").alias("last")), "last").drop("last"), ["rep", "block"])
    path = ["rep", "block", "weight", *NODE, "up_hi", "up_lo", "words", "turn_sha256"]
    tops = sequences.select("rep", zero.alias("block"), "weight", *[zero.alias(c) for c in NODE], no_id.alias("up_hi"), no_id.alias("up_lo"), zero.alias("words"), F.lit(None).cast("string").alias("turn_sha256"))
    steps = materialize(steps.select(path).unionByName(tops.select(path)), "paths")

    inner = steps.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).distinct()
    leaves = materialize(sequences.join(inner, NODE, "left_anti").select("rep", "depth"), "leaves")
    blocks = with_blocks(leaves, "depth").select("rep", "block", F.lit(True).alias("leaf"))
    flagged = steps.join(blocks, ["rep", "block"], "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    nodes = flagged.groupBy(NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.min(F.when(F.col("leaf"), F.col("rep"))).alias("owner"),
        F.max("up_hi").alias("up_hi"), F.max("up_lo").alias("up_lo"), F.max("words").alias("words"), F.max("turn_sha256").alias("turn_sha256"),
    )
    nodes = materialize(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")

    # sums over subtrees
    up_own_path = running(nodes.select(*NODE, "owner", "saved"), ["owner"], "depth", ["saved"], backwards=True).select(*NODE, F.col("saved").alias("below"))
    totals = with_blocks(leaves.join(nodes.groupBy(F.col("owner").alias("rep")).agg(F.sum("saved").alias("total")), "rep"), "depth").select("rep", "block", "total")
    through = steps.join(totals, ["rep", "block"]).groupBy(NODE).agg((F.sum("total") - F.min(F.struct("rep", "total"))["total"]).alias("others"))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    children = materialize(children, "children")
    hot = children.where(F.col("n_children") * HOT_PARENTS >= nodes.count()).select(NODE)  # HOT_PARENTS at most: no child has two parents
    ids = nodes.select(F.col("depth").alias("up_depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
    up = ["up_depth", "up_hi", "up_lo"]
    hot_ids = F.broadcast(ids.join(F.broadcast(hot.toDF(*up)), up))
    below = nodes.select(*NODE, (F.col("depth") - 1).alias("up_depth"), "up_hi", "up_lo").where("depth > 0")
    parents = below.join(hot_ids, up).unionByName(below.join(hot_ids, up, "left_anti").join(ids, up)).select(*NODE, "parent_conv_id")

    out = nodes.join(children, NODE, "left").join(parents, NODE, "left").join(up_own_path, NODE).join(through, NODE).join(end_lists(ends), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", (F.col("below") + F.col("others")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"), "turn_sha256",
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    return prefix_trie(*rebuilt(ordered_turns(read_table(spark, sf_dir, "conversations")))).drop("turn_sha256")


#: CRC-32 bit by bit. Subtrees are pairs of nodes that share a conversation.
OP13_SQL = """
with turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as p
    from conversations where conv_id is not null
), convs as (
    select conv_id, max(p) as n,
           xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)),
               lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)), 4294967295::bigint) % 4 as h
    from turns group by conv_id
), shared as (
    select c.conv_id, c.n, c.h, least(c.h, coalesce(f.n, 0)) as k from convs c left join convs f on f.conv_id = c.conv_id - c.conv_id % 20
), rebuilt as (
    select s.conv_id, t.p as d, role, text from shared s join turns t on t.conv_id = s.conv_id - s.conv_id % 20 and t.p <= s.k
    union all
    select s.conv_id, t.p - s.h + s.k, role, text from shared s join turns t on t.conv_id = s.conv_id and t.p > s.h
), prefix as (
    select conv_id, d, sha256(string_agg(sha256(length(role) || ':' || role || text), ',') over (partition by conv_id order by d)) as node,
           len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words, max(d) over (partition by conv_id) as last
    from rebuilt
    union all
    select s.conv_id, 0, '', 0, s.k + greatest(s.n - s.h, 0) from shared s
), up as (
    select *, lag(node) over (partition by conv_id order by d) as parent from prefix
), nodes as (
    select node, d as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(parent) as parent, (count(*) - 1) * max(words) as saved,
           sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (last = d), '')) as ends_sha256
    from up group by node, d
), kids as (
    select parent, count(*) as n from nodes where parent is not null group by parent
), pairs as (
    select distinct a.node as top, b.node as node from up a join up b on a.conv_id = b.conv_id and b.d >= a.d
), sums as (
    select top, sum(saved)::bigint as saved_tokens, count(*) filter (kids.n is null) as n_leaves
    from pairs join nodes using (node) left join kids on kids.parent = node group by top
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(kids.n, 0)::bigint as n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n left join nodes p on p.node = n.parent and n.parent is not null left join kids on kids.parent = n.node join sums s on s.top = n.node
"""
