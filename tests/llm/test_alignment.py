"""Cross-tokenizer alignment against both libraries and plain loops."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fxlake.llm import alignment

SF = "/root/testdata/sf0.001"
EDGE = [
    (1, None, 7), (2, "", 7), (3, " \n ", None), (4, "naïve ünïcode 😀 text, twice. " * 50, 7), (5, "a b", 7), (5, "a b", 7), (None, "no id", 7), (6, "x▁y", 7), (7, " two  spaces", 7),
    (8, "<|endoftext|> <s> </s> <unk> <0x41>", 7), (9, "\ttab\r\nline\x00nul", 7), (10, "你好 Привет ​﻿ ﬁ ①", 7), (11, " " * 30000 + "x", 7), (12, "ab" * 20000, 7),
]


@pytest.fixture(scope="module")
def pair():
    return alignment.default_pair()


def plainly(pair, docs):
    a_file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_file.encode_special_tokens = True
    b_file = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    name, byte_of = {v: k for k, v in a_file.get_vocab().items()}, alignment._byte_of()

    def spelled(piece):
        single = re.fullmatch("<0x(..)>", piece)
        return bytes([int(single[1], 16)]) if single else piece.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for doc, text in docs:
        a, b = ([], []) if not text else (a_file.encode(" " + text, add_special_tokens=False).ids, b_file.encode(text))
        of_a, of_b = [bytes(byte_of[c] for c in name[i]) for i in a], [spelled(b_file.id_to_piece(i)) for i in b]
        if b"".join(of_a) != (" " + (text or "")).encode() or b"".join(of_b) != (" " + (text or "")).encode():
            a, b, of_a, of_b = [], [], [], []
        ends = []
        for pieces in (of_a, of_b):
            at, here = 0, {}
            for i, x in enumerate(pieces):
                at += len(x)
                here[at] = i
            ends.append(here)
        links, groups, i, j = [], [], 0, 0
        for cut in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][cut], ends[1][cut]
            links.append((a[x], b[y]))
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        counts.update(links)
        rows.append((doc, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    whole = [(d, na, nb, len(links), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha) for d, na, nb, links, sha in rows]
    return sorted(whole, key=repr), counts


@pytest.mark.parametrize("hot, task", [(1 << 16, 1 << 20), (40, 50)])
def test_alignment_is_brute_force(spark, pair, monkeypatch, hot, task):
    """With the usual bounds, and with bounds that send most pairs through the join and flush the tasks' sums."""
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment, "TASK_PAIRS", task)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    got, pairs = alignment.align(docs, pair)
    want, counts = plainly(pair, [tuple(r) for r in docs.collect()])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == counts


def test_edges(spark, pair):
    df = spark.createDataFrame(EDGE, "doc_id bigint, text string, n_a int")
    got = sorted((tuple(r) for r in alignment.align(df, pair)[0].collect()), key=repr)
    assert got == plainly(pair, [x[:2] for x in EDGE])[0]
    of = {r[0]: r for r in got}
    assert of[1][1:] == of[2][1:] == of[6][1:] == (0, 0, 0, 0, 0, 0, "") and of[8][1] > 0
    documents, pairs = alignment.align(df.where("false"), pair)
    assert documents.count() == pairs.count() == 0
    only_null = alignment.align(df.where("text is null"), pair)[0].collect()
    assert [tuple(r)[1:] for r in only_null] == [(0, 0, 0, 0, 0, 0, "")]


def test_same_bytes(pair):
    known = [(a, b) for a, b in enumerate(pair.same) if b >= 0]
    assert len(known) > 10000 and all(pair.bytes_a[a] == pair.bytes_b[b] for a, b in known) and len({b for _, b in known}) == len(known)


def test_wrong_files_are_refused(tmp_path):
    other = tmp_path / "other.json"
    other.write_text('{"normalizer": {"type": "NFC"}, "pre_tokenizer": null, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}')
    with pytest.raises(ValueError, match="byte-level"):
        alignment.read_pair(str(other), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
