"""The prefix trie against a plain one, with blocks so small that every conversation has several."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from fxlake.llm import conversations, ordering

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plainly(rows):
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    for turns in own.values():
        turns.sort()
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = tuple(x[3:] for x in own.get(first, [])[:h] + turns[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in kids[node])
        leaves[node] = sum(leaves[x] for x in kids[node]) or 1
    return sorted(
        (
            (
                min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
            )
            for n, m in members.items()
        ),
        key=repr,
    )


def trie(df):
    return sorted((tuple(r) for r in conversations.prefix_trie(*conversations.rebuilt(conversations.ordered_turns(df))).drop("turn_sha256").collect()), key=repr)


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in conversations.op13_prefix_trie(spark, SF).collect()), key=repr) == plainly(rows)


@pytest.mark.parametrize("block, piece, hot", [(1024, 4096, 1000), (2, 3, 3)])
def test_random_conversations(spark, monkeypatch, block, piece, hot):
    """Few different turns, so that sequences meet, end inside others and repeat; null and repeated turns, nulls in any column."""
    for module in (conversations, ordering):
        monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(conversations, "PIECE", piece)
    monkeypatch.setattr(conversations, "HOT_PARENTS", hot)
    rng, rows = random.Random(block), []
    for c in [*range(-25, 70), *range(1000, 1030)]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", None, ""]), rng.choice(["a b", "a b", None, "", "c\td  e"]), 5))
    rows += [(None, 1, "user", "of no conversation", 5), rows[0], rows[0]]
    rows += [(2000, t, "user", "loop", 5) for t in range(40)] + [(2001, t, "user", "loop", 5) for t in range(39)]
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plainly(rows)


def test_edges(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    # the CRC-32 of "3" leaves 1: its only turn goes, its family's first conversation is absent
    assert zlib.crc32(b"3") % 4 and trie(spark.createDataFrame([(3, 1, "user", "gone", 5)], SCHEMA)) == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]
    long = "word " * 50000
    rows = [(0, 1, "user", long, 5), (40, 1, "user", long, 5)]
    assert trie(spark.createDataFrame(rows, SCHEMA)) == plainly(rows)


def test_as_they_are_and_texts(spark):
    rows = [(1, 1, "user", "hi", 5), (1, 2, "assistant", "yes", 5), (2, 1, "user", "hi", 5), (2, 2, "assistant", "no", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = conversations.prefix_trie(*conversations.as_they_are(conversations.ordered_turns(df)))
    named = got.join(conversations.turn_texts(df), "turn_sha256", "left").collect()
    assert sorted((r["depth"], r["text"] or "", r["n_convs"]) for r in named) == [(0, "", 2), (1, "hi", 2), (2, "no", 1), (2, "yes", 1)]
