"""The training-data operators against brute force, exact round trips and held-out accuracy, on small tables."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fxlake.llm import bpe, components, decontaminate, licenses, linededup, media, minhash, passages, pii, quality, tokencount

SF = "/root/testdata/sf0.001"
LONG = "long " + "word%d " * 3000 % tuple(range(3000))
EDGE = [(1, None, "en"), (2, "", "en"), (3, " \n ", None), (4, LONG, "en"), (5, "a b", "x"), (5, "a b", "x"), (None, "no id here at all", "en"), (7, "naïve ünïcode \U0001f600 text, twice. " * 3, "de"), (8, "!" * 3000, "en")]
SCHEMA = "doc_id bigint, text string, score string"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in each column, empty and long texts, repeated rows, and an extra column whose name clashes."""
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def vocabulary():
    path, pattern = bpe.default_vocabulary()
    return bpe.read_ranks(None, path), pattern


# ---------------------------------------------------------------- 1 and 2


def test_bpe_is_tiktoken(spark, docs, edge):
    import tiktoken

    ranks, pattern = vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, edge.select("doc_id", "text")):
        for r in bpe.decode(bpe.encode(df, ranks, pattern), ranks).collect():
            assert list(np.frombuffer(r["token_ids"], "<u4")) == theirs.encode_ordinary(r["text"] or "")
            assert r["decoded"] == (r["text"] or "").encode()
    whole = bpe.PerfectHash.build(ranks)
    assert len(set(whole.keys)) == len(whole.keys) == len(ranks)
    assert all(whole.get(k) == v for k, v in list(ranks.items())[::97]) and whole.get(b"no such token") is None
    rng = random.Random(3)
    for _ in range(300):
        s = "".join(rng.choice("abcdefghijé ") for _ in range(rng.randint(1, 30)))
        assert bpe.merge_bytes(s.encode(), ranks) == theirs._encode_single_piece(s.encode())
    assert bpe.encode(edge.where("false"), ranks, pattern).count() == 0


def test_token_counts(spark):
    ranks, _ = vocabulary()
    rows = [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate([3, 0, 40, 1, 0, 0, 17, 8])]
    df = spark.createDataFrame(rows, "doc_id bigint, token_ids binary").coalesce(1)
    for size in (1, 4, 7, 1000):
        scanned = tokencount.scan(tokencount.pack(df, 99, block_ids=size), 99)
        counted = tokencount.count_tokens(scanned).join(tokencount.named(scanned), ["file", "document"])
        assert {r["doc_id"]: r["n_tokens"] for r in counted.collect()} == {i: len(x) // 4 for i, x in rows}
    open_end = spark.createDataFrame([(0, 0, np.array([5, 99, 6], "<u4").tobytes()), (0, 1, np.array([7], "<u4").tobytes())], "file bigint, block bigint, ids binary")
    got = tokencount.count_tokens(tokencount.scan(open_end, 99)).orderBy("document").collect()
    assert [(r["n_tokens"], r["closed"]) for r in got] == [(1, True), (2, False)]


def test_flat_token_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    for n, name in ((0, "empty"), (1, "a"), (12, "b"), (5003, "c d")):
        (tmp_path / f"{name}.bin").write_bytes(rng.choice([1, 2, 99], n).astype("<u4").tobytes())
    for size in (3, 4, 1000):
        counted = tokencount.count_tokens(tokencount.scan(tokencount.read_token_file(spark, str(tmp_path), size), 99)).collect()
        for path in tmp_path.iterdir():
            ids = np.fromfile(path, "<u4").tolist()
            plain = [len(part.split()) for part in " ".join("|" if i == 99 else "x" for i in ids).split("|")]
            plain = plain if plain[-1] else plain[:-1]
            own = {r["document"]: r["n_tokens"] for r in counted if r["file"].endswith(f"/{path.name}")}
            assert own == dict(enumerate(plain))
    (tmp_path / "odd.bin").write_bytes(b"123456")
    with pytest.raises(Exception, match="no whole ids"):
        tokencount.read_token_file(spark, f"{tmp_path}/odd.bin").collect()


def test_sample_is_bounded_before_texts_are_collected(spark):
    docs = spark.createDataFrame([(i, "é" * 50) for i in range(20)] + [(0, "longer " * 50), (0, "é" * 50)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    sample = lambda rows, most: quality._samples(docs, {"one": (labels, rows), "odd": (labels.where("quality = 1"), 5)}, most, "text")
    assert len(sample(100, 1 << 20)["one"]) == 20
    assert [t for _, t in sample(100, 350)["one"]] == ["é" * 50] * 3  # bytes, not characters
    assert len(sample(7, 1 << 20)["one"]) == 7
    assert len(sample(7, 1 << 20)["odd"]) == 5 and len(sample(7, 350)["odd"]) == 3  # each part has the bounds to itself


# ---------------------------------------------------------------- 3


def test_quality(spark, edge):
    rng, words = random.Random(1), [f"w{i}" for i in range(400)]
    good = lambda: " ".join(rng.choices(words, k=80))
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choices(words, k=80))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, q int")
    model = quality.fit(df, df.select("doc_id", F.col("q").alias("quality")))
    out = quality.score(df, model).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["score"] >= quality.THRESHOLD) == bool(r["q"]) for r in held) >= 0.95 * len(held)
    scored = quality.score(edge, model, out="quality_score")
    assert scored.columns == [*edge.columns, "quality_score"] and all(0 <= r["quality_score"] <= 1 for r in scored.collect())
    none = quality.fit(df, df.select("doc_id", F.lit(1).alias("quality")).limit(0))
    assert quality.score(edge, none, out="s").count() == len(EDGE)


# ---------------------------------------------------------------- 4


def coded(coefficients, quantiser=1):
    """A one-component progressive JPEG with ordinary Huffman codes: 8-bit codes for every symbol."""
    symbols = [0x00, 0xF0] + [r << 4 | s for r in range(15) for s in range(1, 9)] + [1 << 4, 2 << 4]
    table = lambda kind: bytes([kind << 4]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    code = {s: f"{i:08b}" for i, s in enumerate(symbols)}

    def amount(v):
        size = abs(v).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    def pack(bits):
        data = bytes(int((bits + "1" * (-len(bits) % 8))[i : i + 8], 2) for i in range(0, len(bits), 8))
        return data.replace(b"\xff", b"\xff\x00")

    def shifted(v):
        return abs(v) >> 1 if v >= 0 else -(abs(v) >> 1)

    first, before = "", 0
    for block in coefficients:
        size, extra = amount((block[0] >> 1) - before)
        first, before = first + f"{size:04b}" + extra, block[0] >> 1
    dc_table = bytes([0]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    ac = ""
    for block in coefficients:
        run = 0
        for v in map(shifted, block[1:64]):
            if not v:
                run += 1
                continue
            while run > 15:
                ac, run = ac + code[0xF0], run - 16
            size, extra = amount(v)
            ac, run = ac + code[run << 4 | size] + extra, 0
        if run:
            ac += code[0x00]
    refine = ""
    for block in coefficients:
        run, corrections = 0, ""
        last = max([k for k in range(1, 64) if abs(block[k]) == 1], default=0)
        for k in range(1, 64):
            v = block[k]
            if abs(v) > 1:
                corrections += str(abs(v) & 1)
            elif abs(v) == 1:
                refine += code[run << 4 | 1] + ("1" if v > 0 else "0") + corrections
                run, corrections = 0, ""
            else:
                run += 1
                if run == 16 and k < last:
                    refine, run, corrections = refine + code[0xF0] + corrections, 0, ""
        refine += code[0x00] + corrections if run or corrections else ""
    seg = media._segment
    scan = lambda band, high, low, bits: media._scan([(1, 0)], band, high, low, b"") + pack(bits)
    out = b"\xff\xd8" + seg(0xDB, bytes([0] + [quantiser] * 64)) + seg(0xC2, bytes([8, 0, 8, 0, 8 * len(coefficients), 1, 1, 0x11, 0]))
    out += seg(0xC4, dc_table) + seg(0xC4, table(1)) + scan((0, 0), 0, 1, first) + scan((1, 63), 0, 1, ac)
    return out + scan((0, 0), 1, 0, "".join(str(b[0] & 1) for b in coefficients)) + scan((1, 63), 1, 0, refine) + b"\xff\xd9"


def test_jpeg_any_layout():
    rng = random.Random(5)
    blocks = [[rng.randint(-200, 200)] + [rng.choice([0, 0, 0, 0, 1, -1, 2, -3, 9, -100]) for _ in range(63)] for _ in range(6)]
    blocks.append([0] * 64)
    width, height, parts, quantisers, _ = media.decode_scans(coded(blocks))
    assert (width, height) == (56, 8) and parts[0].coefficients[0].tolist() == blocks
    flat = media.decode_scans(coded([[-80] + [0] * 63] * 2))
    rgb = media.rgb_tensor(*flat[:4])
    assert rgb.shape == (8, 16, 3) and (rgb == 118).all()  # 128 - 80 / 8


def test_media_round_trip(spark, docs, edge):
    for df in (docs.limit(60), edge.select("doc_id", "text")):
        for r in media.decode_media(media.encode_media(df)).collect():
            payload = media.pad((r["text"] or "").encode())
            d = r["decoded"]
            assert d["payload"] == payload and len(payload) % media.UNIT == 0 and len(payload) > 0
            assert len(d["rgb"]) == 3 * d["width"] * d["height"]
    with pytest.raises(ValueError):
        media.decode_scans(b"no file")


# ---------------------------------------------------------------- 5


def plain_spans(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii(spark, docs, edge):
    rng = random.Random(7)
    pieces = ["a.b@c.de", "x@y", "@", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "4111 1111 1111 1111", "+1 (202) 555-0100", "+12", "12-34", " ", "é", ".", "-", "q@q@r.s", "0041111111111111111"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(12)) for _ in range(400)]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)
    found = pii.find(docs).cache()
    out = pii.with_added(found, pii.fit(found)).collect()
    for r in out:
        base = [(s["start"], s["end"], s["kind"]) for s in r["base"]]
        assert base == plain_spans(r["text"] or "")
        assert set(base) <= {(s["start"], s["end"], s["kind"]) for s in r["spans"]}
    more = spark.createDataFrame([(i, f"some words here password=ab{i}cdef12{i % 9}3456789 and more") for i in range(40)], "doc_id bigint, text string")
    found = pii.find(more)
    assert all("secret" in [s["kind"] for s in r["spans"]] for r in pii.with_added(found, pii.fit(found)).collect())
    clash = docs.selectExpr("doc_id", "text", "1 as base", "2 as candidates", "3 as `odd.name`")
    assert pii.find(clash).columns == ["doc_id", "text", "odd.name", "base", "candidates"]
    long = {"secret": "token=" + "aB3" * 200, "email": "x" * 100 + "@example dot com"}
    assert all(any(c[2] == kind and c[1] == len(text) for c in pii.candidates(text, [])) for kind, text in long.items())
    found = pii.find(edge)
    assert pii.with_added(found, pii.fit(found.where("false"))).count() == len(EDGE)


# ---------------------------------------------------------------- 6


def test_compact_windows_cover():
    rng = np.random.default_rng(2)
    for n in (0, 3, 30, 61):
        h = rng.permutation(n).astype(np.uint64)
        found = passages.compact_windows(h, 5)
        for i in range(n):
            for j in range(i + 4, n):
                assert sum(low <= i <= at <= j <= high for low, at, high in found) == 1
        assert all(h[at] == h[low : high + 1].min() for low, at, high in found)


def test_passages(spark, docs, edge):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, hot = text(60), text(51)
    rows = [(i, " ".join(text(80) + (shared if i in (3, 17) else []) + (hot if i % 4 == 0 else []) + text(40)), "x") for i in range(60)]
    rows += [(100 + r[0] if r[0] is not None else None, r[1], r[2]) for r in EDGE]
    got = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    ids = {r["doc_a"] for r in got} | {r["doc_b"] for r in got}
    assert ids == {3, 17} | {i for i in range(60) if i % 4 == 0}
    assert all(r["n_words"] >= 50 and r["similarity"] >= 0.8 for r in got)
    edges = spark.createDataFrame([(r["doc_a"], r["doc_b"]) for r in got], "a bigint, b bigint")
    assert {r["component"] for r in components.connected_components(edges).collect()} == {0, 3}
    assert passages.repeated_passages(edge.where("false")).count() == 0


def test_edited_passages(spark):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, pairs = [], set()
    for k in range(240):
        shared = text((60, 70, 80, 95)[k % 4])
        other, at = list(shared), rng.randrange(5, len(shared) - 5)
        if k % 3 == 0:
            other[at] = "replaced"
        elif k % 3 == 1:
            other.insert(at, "inserted")
        else:
            del other[at]
        one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (shared, other))
        assert len(one & two) >= 0.8 * len(one | two)
        rows += [(2 * k, " ".join(text(60) + shared + text(40))), (2 * k + 1, " ".join(text(30) + other + text(70)))]
        pairs.add((2 * k, 2 * k + 1))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_a"], r["doc_b"]) for r in got} <= pairs and len({r["doc_a"] for r in got}) >= 0.98 * len(pairs)
    assert all(r["n_words"] >= 50 and r["similarity"] >= 0.8 for r in got)


def test_short_edited_passages_are_found(spark):
    """One word changed, inserted or deleted in passages of 50 to 60 words, wherever their similarity stays at 0.8."""
    rng = random.Random(14)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, n = [], 0
    while n < 240:
        shared = text((51, 54, 57, 60)[n % 4])
        other, at = list(shared), rng.randrange(len(shared))
        other[at : at + (n % 3 != 1)] = ["changed"] * (n % 3 != 2)
        one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (shared, other))
        if len(other) >= 50 and len(one & two) >= 0.8 * len(one | two):
            rows += [(2 * n, " ".join(text(60) + shared + text(40))), (2 * n + 1, " ".join(text(30) + other + text(70)))]
            n += 1
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r["doc_a"] // 2 == r["doc_b"] // 2 for r in got) and len({r["doc_a"] for r in got}) >= 0.9 * n


def test_edited_passages_beside_equal_ones():
    rng = random.Random(16)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    equal, edited = text(70), text(60)
    other = [*edited[:30], "changed", *edited[31:]]
    one, two = text(20) + equal + text(30) + edited + text(9), text(5) + equal + text(40) + other + text(7)
    got = passages.passages_between(passages.Sorted(" ".join(one)), passages.Sorted(" ".join(two)), [(120, 145, -5), (20, 86, -15)])
    assert [(f[0], f[2], f[1] - f[0] + 4) for f in got] == [(20, 5, 70), (120, 115, 60)] and got[0][4] == 1 and 0.8 <= got[1][4] < 1


@pytest.mark.parametrize("most", [1, 97, 5000, 1 << 21])
def test_equal_runs_don_t_depend_on_slices(monkeypatch, most):
    """Repeated tokens: all maximal equal runs of brute force, whatever the matches held at a time."""
    monkeypatch.setattr(passages, "SLICE_MATCHES", most)
    rng = random.Random(17)
    words = [f"w{rng.randrange(3)}" for _ in range(60)]
    shared = [f"s{i}" for i in range(55)]
    one, two = (" ".join([*words, *shared, *words, *extra]) for extra in (["x"], words))
    a, b = (passages.Sorted(t).elements for t in (one, two))
    want = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= passages.MIN_ELEMENTS:
                    want.add((i, i + n, j, j + n, 1.0))
    got = passages.equal_runs(passages._matches_by_slices(a, b, np.argsort(b, kind="stable")))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1


def test_long_texts_of_repeated_tokens_keep_their_equal_run():
    rng = random.Random(18)
    noise = lambda n: [f"w{rng.randrange(2)}" for _ in range(n)]
    shared = [f"s{i}" for i in range(60)]
    for n in (2000, 3000):
        one, two = (passages.Sorted(" ".join(["w0 w1"] * (n // 2) + shared + noise(50))) for _ in range(2))
        assert any(f[1] - f[0] >= 56 and f[0] <= n and f[1] >= n + 56 for f in passages.passages_between(one, two, [(0, 50, 2)]))


def test_passages_leave_no_copies_of_the_texts_behind(spark, docs, monkeypatch):
    """Of the tables that are written on the way, only the links and the classes are still there when the result is read."""
    left = {}
    write, drop = passages.materialize, passages.release

    def materialize(df, name):
        out = write(df, name)
        left[out.stored_at] = name
        return out

    def release(*tables, **options):
        for table in tables:
            left.pop(table.stored_at)
        drop(*tables, **options)

    monkeypatch.setattr(passages, "materialize", materialize)
    monkeypatch.setattr(passages, "release", release)
    assert passages.repeated_passages(docs.limit(60)).count() >= 0
    assert sorted(left.values()) == ["passage-classes", "passage-links", "passage-links"]


def test_passages_of_repeated_ids(spark):
    rng = random.Random(15)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = text(60)
    rows = [(1, " ".join(text(90))), (1, " ".join(text(20) + shared)), (1, " ".join(text(50) + shared)), (2, " ".join(shared + text(9))), (2, None)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_a"], r["doc_b"]) for r in got} == {(1, 2)} and {r["start_a"] for r in got} <= {20, 50} and all(r["n_words"] == 60 for r in got)


def test_interleaved_variants_of_a_group_meet(spark):
    # windows of one group, of two kinds: those narrow on the left share 46 places, those narrow on the right as well,
    # but not one of each
    rows = [(7, d, 100 - (5 if d % 2 else 50), 100, 100 + (50 if d % 2 else 5), 0) for d in range(12)]
    windows = spark.createDataFrame(rows, "key bigint, doc bigint, l int, c int, r int, f tinyint")
    first = passages._paired(windows.coalesce(1)).collect()
    links = spark.createDataFrame([(r["a"], r["b"]) for r in first], "a bigint, b bigint")
    found = passages._bridging(windows, links).collect()
    edges = spark.createDataFrame([(r["a"], r["b"]) for r in [*first, *found]], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {d: d % 2 for d in range(12)}


def test_no_member_of_a_passage_group_hides_another(spark):
    """Three unlike variants of 40 words beside one another's: all pairs of different texts with a passage are rows, or given by
    two equal passages of one partner that have 50 words in common."""
    rng = random.Random(19)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    whole, rows = text(140), []
    for d in range(30):  # parts of 60 words, 20 words apart: neighbours have 40 words in common, those of one part all
        k = d % 5
        rows.append((d, " ".join(text(30) + whole[20 * k : 20 * k + 60] + text(30))))
    rows += [(100 + d, rows[d][1]) for d in range(4)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    direct = {(r["doc_a"], r["doc_b"]) for r in got}
    spans = {}
    for r in got:
        if r["similarity"] == 1:
            spans.setdefault(r["doc_a"], []).append((r["doc_b"], r["start_a"], r["n_words"]))
            spans.setdefault(r["doc_b"], []).append((r["doc_a"], r["start_b"], r["n_words"]))
    given = {tuple(sorted((x, y))) for each in spans.values() for x, s, n in each for y, t, m in each if x != y and min(s + n, t + m) - max(s, t) >= 50}
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if a % 5 == b % 5} | {(d, 100 + d) for d in range(4)}
    assert want <= direct | given and {(a, b) for a, b in direct if b < 100} <= want


def test_edited_members_of_a_group_meet(spark):
    """Members of a group that are like each other, but not like the first one and not neighbours: equal on one side of the minimum."""
    rows = [(7, d, 100 - (5 if d % 3 == 0 else 50 if d % 3 == 1 else 30), 100, 100 + (50 if d % 3 == 0 else 5 if d % 3 == 1 else 30)) for d in range(30)]
    windows = spark.createDataFrame(rows, "key bigint, doc bigint, l int, c int, r int")
    first = {(r["a"], r["b"]) for r in passages._paired(windows.coalesce(1)).collect()}
    links = spark.createDataFrame(sorted(first), "a bigint, b bigint")
    rest = {(r["a"], r["b"]) for r in passages._bridging(windows, links).collect()}
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if a % 3 == b % 3}
    assert first | rest == want
    # what has the first one's stretch word for word is its core, and given by it
    equal = spark.createDataFrame([(0, d, 60, 120) for d in range(3, 30, 3)], "leader bigint, doc bigint, start bigint, stop bigint")
    fewer = {(r["a"], r["b"]) for r in passages._bridging(windows, links, equal).collect()}
    assert first | fewer >= {(a, b) for a, b in want if a % 3} and all(a % 3 for a, b in fewer)


# ---------------------------------------------------------------- 7


def test_decontamination(spark, edge):
    items = spark.createDataFrame(
        [(1, "A train leaves the station with 120 passengers and travels 45 km before it stops near Boston for lunch"), (2, "too short"), (3, None), (None, "an item without any id that nobody can ever name")],
        "item_id bigint, text string",
    )
    rows = [
        (1, "intro words. A train leaves the station with 120 passengers and travels 45 km before it stops near Boston for lunch. more", "x"),
        (2, "A train leaves the station with 99 passengers and travels 7 km before it stops near Denver for lunch", "x"),
        (3, "A train leaves the station with some passengers who never come back to tell anybody about it at all", "x"),
        (4, "too short", "x"),
    ]
    rows += [(100 + (r[0] or 0), *r[1:]) for r in EDGE]
    out = {r["doc_id"]: r for r in decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), items).collect()}
    assert set(out) == {1, 2} and out[1]["n_changed"] == 0 and out[2]["n_changed"] == 3 and out[2]["n_slots"] == 4
    assert decontaminate.leaks(edge, items.where("false")).count() == 0
    clash = spark.createDataFrame([(1, "He paid 5 euros to Anna and then 5 euros to Bertha before 6 of them left the old harbour")], "item_id bigint, text string")
    mixed = spark.createDataFrame([(1, "He paid 7 euros to Anna and then 8 euros to Bertha before 6 of them left the old harbour")], "doc_id bigint, text string")
    assert decontaminate.leaks(mixed, clash).count() == 0  # one value stands for two


def test_every_alignment_is_checked(spark):
    say = lambda a, b: f"Anna has {a} red apples in her basket and gives {b} of them to the old man who lives near the mill by the river"
    items = spark.createDataFrame([(1, say(3, 3))], "item_id bigint, text string")
    edited = say(3, 3).replace("river", "lake")
    rows = [(1, f"{say(2, 5)}. Then {say(3, 3)}."), (2, f"{say(2, 5)}. Then {edited}."), (3, f"{say(2, 5)}. Then {say(4, 7)}.")]
    out = {r["doc_id"]: r for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()}
    assert set(out) == {1, 2} and all(r["n_changed"] == 0 and r["n_slots"] == 2 for r in out.values())


def test_share_of_windows_and_repeated_documents(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id bigint, text string")  # two windows
    half, whole = "alpha beta gamma delta epsilon other", "so alpha beta gamma delta epsilon zeta it is"
    rows = [(1, half), (2, whole), (2, whole), (3, half), (3, whole)]
    out = decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()
    assert sorted((r["doc_id"], r["n_matched"], r["n_slots"]) for r in out) == [(2, 2, 0), (3, 2, 0)]
    numbers = spark.createDataFrame([(1, "Take 4 apples and 5 pears from the old basket today")], "item_id bigint, text string")
    twice = spark.createDataFrame([(1, "Take 6 apples and 7 pears from the old basket today")] * 2, "doc_id bigint, text string")
    assert [(r["n_slots"], r["n_changed"]) for r in decontaminate.leaks(twice, numbers).collect()] == [(2, 2)]


# ---------------------------------------------------------------- 8


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, docs, edge):
    rng = random.Random(8)
    base = [f"w{rng.randrange(1000)}" for _ in range(150)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i in range(1000, 1120):  # a dense group around one text, and chains of small steps
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(150)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "ONE  two"), (2004, LONG)]
    want = brute_components(rows)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert minhash.near_duplicates(edge).count() == len(EDGE)
    assert minhash.near_duplicates(edge.where("false")).count() == 0


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows)


# ---------------------------------------------------------------- 9


def test_licenses(spark, edge):
    assert licenses.increasing([3, 1, 4, 1, 5, 9, 2, 6]) in ([1, 2, 4, 7], [1, 2, 4, 5]) and licenses.increasing([]) == []
    mit = licenses.NOTICES["MIT text"]
    rows = [(1, f"code code {mit} more code", "x"), (2, f"{mit} {mit}", "x"), (3, mit.replace("Software", "Program").replace("hereby", "now"), "x"), (4, "permission to use a license is fun and free", "x")]
    out = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {r["doc_id"]: [(f["license"], f["coverage"]) for f in r["licenses"]] for r in out}
    assert found[1] == [("MIT text", 1.0)] and len(found[2]) == 2 and 0.8 <= found[3][0][1] < 1 and found[4] == []
    assert licenses.scan_licenses(edge).count() == len(EDGE)


def test_edited_long_notices():
    notices = {name: licenses.words_of(n) for name, n in licenses.NOTICES.items()}
    templates = {name: (words, licenses.Counter(words)) for name, words in notices.items()}
    for name in ("MIT text", "ISC text", "Apache-2.0 header", "GPL-3.0 header", "MPL-2.0 header"):
        words, counts = templates[name]
        once = [w for w in words if counts[w] == 1]
        out = set(once[: len(counts) // 5 + 1])  # fewer than 0.8 of the distinct words stay, more than 0.8 of all words
        left = [w for w in words if w not in out]
        found = [f for f in licenses.scan_text(["code", *left, "code"], templates) if f[0] == name]
        assert len(found) == 1 and 0.8 <= len(left) / len(words) < 0.89 and found[0][1] == len(left) / len(words)


def _templates():
    return {name: (words, licenses.Counter(words)) for name, n in licenses.NOTICES.items() if (words := licenses.words_of(n))}


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_insertions_of_any_length_are_found():
    """Foreign words and words of the template itself, inserted at one place or at several."""
    rng, templates = random.Random(21), _templates()
    for n in (1, 5, 6, 7, 10, 20, 40):
        for name, (words, counts) in templates.items():
            if len(words) < 30:
                continue
            for foreign in (True, False):
                if not foreign and n > len(words) // 4:
                    continue
                text = list(words)
                for _ in range(1 if n % 2 else 2):
                    at = rng.randrange(1, len(text))
                    text[at:at] = [f"z{i}" if foreign else rng.choice(words) for i in range(n // (1 if n % 2 else 2))]
                found = [f for f in licenses.scan_text(["code"] * 9 + text + ["code"] * 9, templates) if f[0] == name]
                assert len(found) == 1, (n, name, foreign)
                assert found[0][1] >= _lcs(text, words) / len(words) - (0 if foreign else 0.05)


def test_replaced_words_against_the_longest_common_subsequence():
    rng, templates = random.Random(22), _templates()
    words = templates["MIT text"][0]
    for _ in range(100):
        text = list(words)
        for i in rng.sample(range(len(words)), 30):
            text[i] = rng.choice(("zz", rng.choice(words)))
        expected = _lcs(text, words) >= licenses.COVERAGE * len(words)
        assert expected == any(f[0] == "MIT text" for f in licenses.scan_text(text, templates))


def test_scattered_words_are_no_notice():
    words = licenses.words_of(licenses.NOTICES["ISC text"])
    far = [x for w in words for x in (w, "z", "z", "z")]  # four times as long
    assert not [f for f in licenses.scan_text(far, _templates()) if f[0] == "ISC text"]


# ---------------------------------------------------------------- 10


def test_simhash_is_a_majority(spark):
    texts = ["one two three", "a " * 700 + "b " * 300 + "c", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").select("id", linededup.normalized(F.col("text")).alias("norm"))
    got = {r["id"]: r["simhash"] for r in linededup.simhashes(df).collect()}
    for i, t in enumerate(texts):
        hashes = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in t.split()], "w string").select(F.xxhash64("w")).collect()]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i] & (2**64 - 1) == want


def test_fuzzy_lines(spark, edge):
    line = "the quick brown fox jumps over the lazy dog and then sleeps for a long time in the warm sun of june near " + " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"{line}\nown line one", "x"), (2, f"Own line two!\n{line.upper()}.", "x"), (3, f"third\n\n{line.replace('word7 ', 'word7')}", "x"), (4, "own line ONE", "x"), (5, "!!!\n!!!", "x"), (6, None, "x")]
    out = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1]["n_dropped"] == 0 and out[2]["text"] == "Own line two!" and out[4]["text"] == "" and out[5]["n_dropped"] == 0 and out[6]["text"] is None
    same = linededup.dedup_lines(edge)
    assert same.columns == [*edge.columns, "n_lines", "n_dropped"]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in same.collect()))) == sorted(str(r[:2]) for r in EDGE)  # nothing repeats across ids
    assert linededup.dedup_lines(edge.where("false")).count() == 0


def comparable(c):
    return F.struct(*linededup.comparable(F.col(c)))


def test_edit_similarity(spark):
    rows = [("abcdefghij", "abcdefghix", True), ("abcdefghij", "abcdefgxyz", False), ("w " * 1499 + "w", "w " * 1399 + "v " * 100 + "v", True), ("a", "abc", False), ("w " * 40 + "x", "v " * 40 + "x", False), ("w" * 101, "w" * 70, False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    df = df.select("want", *(comparable(c).alias(c) for c in "ab"))
    assert all(r["want"] == r["got"] for r in df.select("want", linededup.edit_similar(F.col("a"), F.col("b")).alias("got")).collect())


def edited(words, rng, kind):
    """The same words with one-letter typos, or with words replaced, inserted or deleted: 1, or up to a tenth."""
    words = list(words)
    for _ in range(rng.randint(1, max(1, len(words) // 10))):
        at = rng.randrange(len(words))
        if kind == "typo":
            letter = rng.randrange(len(words[at]))
            words[at] = words[at][:letter] + rng.choice("qxz") + words[at][letter + 1 :]
        elif kind == "replace":
            words[at] = "".join(rng.choices("abcdefgh", k=len(words[at])))
        elif kind == "insert":
            words.insert(at, "".join(rng.choices("abcdefgh", k=5)))
        else:
            del words[at]
    return words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_fuzzy_lines_of_ordinary_length(spark):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(3, 9))) for _ in range(800)]
    rows, pairs = [], []
    for k in range(240):
        line = rng.choices(vocabulary, k=rng.randint(10, 30))
        other = edited(line, rng, ("typo", "replace", "insert", "delete")[k % 4])
        a, b = " ".join(line), " ".join(other)
        if distance(a, b) <= 0.2 * max(len(a), len(b)):
            pairs.append(2 * k + 1)
        rows += [(2 * k, a), (2 * k + 1, b)]
    out = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(pairs) > 200 and sum(out[i] for i in pairs) >= 0.98 * len(pairs)
    assert not any(n for i, n in out.items() if i not in pairs)


def test_long_lines_are_compared_by_characters(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=10)) for _ in range(30)]
    line, typos = " ".join(words), " ".join(f"{w[:4]}z{w[5:]}" for w in words)
    df = spark.createDataFrame([(line, typos)], "a string, b string")
    df = df.select(*(comparable(c).alias(c) for c in "ab"))
    assert df.select(linededup.edit_similar(F.col("a"), F.col("b")).alias("got")).first()["got"]


def test_one_letter_is_found_at_every_length(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for k in range(240):
        line = rng.choices(vocabulary, k=(6, 10, 20, 40, 80, 150)[k % 6])
        other = list(line)
        at = rng.randrange(len(line))
        letter = rng.randint(0, len(line[at]))
        other[at] = line[at][:letter] + rng.choice("vwxyz") + line[at][letter:]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
    out = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for n in range(6):
        assert sum(out[2 * k + 1] for k in range(n, 240, 6)) >= 39 and not any(out[2 * k] for k in range(n, 240, 6))


def test_lines_are_linked_by_pieces_as_by_characters(spark):
    """The distances in pieces that come first decide as the distances in characters would, among lines with few pieces edited."""
    rng = random.Random(29)
    pairs = []
    for k in range(60):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 14))) for _ in range(40)]
        other = list(words)
        for at in rng.sample(range(40), 2 + k % 16):
            other[at] = "".join(rng.choices("klmnop", k=len(other[at]))) if rng.random() < 0.6 else other[at][:-1] + "z"
        pairs.append((k, " ".join(words), " ".join(other)))
    cut = lambda text: [(w + " ")[i : i + linededup.PIECE] for w in text.split(" ") for i in range(0, len(w) + 1, linededup.PIECE)]
    few = lambda a, b: distance(cut(a), cut(b)) <= int(max(len(cut(a)), len(cut(b))) * linededup.MAX_PIECES)
    want = {k: few(a, b) and distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9) for k, a, b in pairs}
    df = spark.createDataFrame(pairs, "k int, a string, b string").select("k", *(comparable(c).alias(c) for c in "ab"))
    assert {r["k"]: r["got"] for r in df.select("k", linededup.linked(F.col("a"), F.col("b")).alias("got")).collect()} == want
    assert set(want.values()) == {True, False}


def test_long_words_alone_give_the_same_sketches(spark, docs, monkeypatch):
    odd = spark.createDataFrame([(-1, "-- A  b.\tC\n \n\n,x,\r\nÉté, ΣΑΣ \U00010400 9  "), (-2, None), (-3, "")], docs.schema)
    rows = {}
    for long in (1, linededup.LONG, 99):
        monkeypatch.setattr(linededup, "LONG", long)
        rows[long] = sorted(map(tuple, linededup.occurrences(docs.union(odd), "doc_id", "text").collect()), key=str)
    assert rows[1] == rows[8] == rows[99]
    lines = {(r[0], r[2]): r[4] for r in rows[8] if r[0] < 0}
    assert lines == {(-1, 0): 5, (-1, 3): 1, (-1, 4): 11}


def test_steps_over_small_tables_broadcast_nothing(spark):
    """The driver would build each broadcast table, and its memory holds them: `pipeline` came to 1,523 MB on 0.00 GB."""
    edges = linededup.materialize(spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a bigint, b bigint"), "test-edges")
    for large in (True, False):
        assert "Broadcast" not in components._star(edges, large)._jdf.queryExecution().executedPlan().toString()


def test_line_components_are_those_of_brute_force(spark, docs, monkeypatch):
    """Every pair of lines of at least four words, one key or more in common, against the components of the operator."""
    monkeypatch.setattr(linededup, "BLOCK", 3)
    rng = random.Random(13)
    base = [rng.choices(["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(300)], k=14) for _ in range(12)]
    common = base[0][:5]
    texts = []
    for _ in range(260):  # variants of few lines, and unlike lines that share five words: keys with several components
        line = edited(edited(rng.choice(base), rng, rng.choice(["replace", "insert", "delete"])), rng, "replace")
        texts.append(" ".join([*common, *line] if rng.random() < 0.4 else line))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lines = linededup.materialize(linededup.occurrences(df, "doc_id", "text"), "test-lines")
    sketches = {r["doc_id"]: (r["id"], {r[f"s{i}"] for i in range(linededup.SKETCH)} - {None}) for r in lines.collect()}
    parent = {}
    find = lambda i: i if parent.setdefault(i, i) == i else find(parent[i])
    for i, one in enumerate(texts):
        for j in range(i):
            if len(sketches[i][1] & sketches[j][1]) >= linededup.SHARED and distance(one, texts[j]) <= 0.2 * max(len(one), len(texts[j])):
                x, y = find(sketches[i][0]), find(sketches[j][0])
                parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in linededup.line_components(df, lines).collect()}
    want = {i: find(i) for i in list(parent)}
    groups = lambda labels: {frozenset(k for k, v in labels.items() if v == c) for c in set(labels.values())}
    assert groups({i: c for i, c in got.items()}) == {g for g in groups(want) if len(g) > 1}


def test_lines_of_repeated_ids_and_clashing_names(spark):
    rows = [(1, "a line that stands twice\nanother line of mine", 7), (1, "something else entirely\na quite different second line", 8), (2, "A line that stands twice.\nmore of it here", 9)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int"), counts=("lines", "dropped"))
    assert out.columns == ["doc_id", "text", "n_lines", "lines", "dropped"]
    assert sorted(tuple(r) for r in out.collect()) == sorted([(*rows[0], 2, 0), (*rows[1], 2, 0), (2, "more of it here", 9, 2, 1)])


# ---------------------------------------------------------------- components, pipeline


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}
    find = lambda i: i if parent.setdefault(i, i) == i else find(parent[i])
    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for p in pairs if p[0] != p[1] for i in p}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = out.count()
        assert 0 < kept <= docs.count()
        if name == "near_duplicates":
            assert {r["doc_id"] for r in out.collect()} == {i for i, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]).items() if i == c}
        docs = linededup.materialize(out, f"test-{name}")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("not round_trip").count() == 0 and last.count() == docs.count()


def test_every_stage_takes_the_edge_table(spark):
    """Nulls, empty and long texts, repeated rows, clashing names; and the same table without rows."""
    import corpus_pipeline

    clash = ("score", "n_lines", "n_dropped", "kept", "component_id", "n_tokens", "fold", "quality", "id", "text_b")
    docs = spark.createDataFrame(EDGE, SCHEMA).select("doc_id", "text", F.lit("s").alias("source"), F.lit("en").alias("lang"), F.char_length("text").alias("n_chars"), *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "tokens":
            assert len(rows) == len(EDGE) and all(r["round_trip"] for r in rows)
        else:
            assert out.columns == docs.columns and all(r[c] == i for r in rows for i, c in enumerate(clash))
            assert {r["doc_id"] for r in rows} <= {e[0] for e in EDGE}
            if name != "quality":
                assert None in {r["doc_id"] for r in rows}  # rows without an id stay
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_lines_stage_is_the_operator(spark, docs):
    """Of brute force over equal lines, each line stays once; no document goes that has a line left."""
    import corpus_pipeline

    rows = [(1, "the quick brown fox jumps\nonly here"), (2, "The quick, brown fox jumps!"), (3, "the quick brown fox jumps\nand this one too")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.char_length("text"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 3: ("and this one too", 16)}


def test_quality_stage_is_the_threshold(spark):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels), out="q")
    want = {r["doc_id"] for r in scored.collect() if r["q"] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in corpus_pipeline.reject_low_quality(spark, docs, SF).collect()} == want


def test_pipeline_drops_copies_at_four_fifths(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    changed = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(words)]  # 86 of 106 shingles in common
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, "another text of its own")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF).collect()} == {1, 3}


def test_passages_shuffle_texts_once_and_drop_shuffles_before_each_step(spark, monkeypatch):
    """All texts went through two shuffles, which were still there when the windows were shuffled."""
    from fxlake.llm import passages

    plans, dropped, write, drop = {}, [], passages.materialize, passages.drop_shuffles
    monkeypatch.setattr(passages, "materialize", lambda df, name: plans.setdefault(name, (df._jdf.queryExecution().executedPlan().toString(), len(dropped))) and write(df, name))
    monkeypatch.setattr(passages, "drop_shuffles", lambda s: dropped.append(1) or drop(s))
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(1, text), (2, text), (2, text), (3, f"other {text}"), (3, "x"), (4, None), (None, text)]
    links = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_a"], r["doc_b"]) for r in links) == [(1, 2), (1, 3)]
    import re

    assert not re.search(r"Exchange hashpartitioning\(doc#\d+L, \d+\)", plans["passage-texts-once"][0]) and "hashpartitioning(doc#" in plans["passage-texts-once"][0]
    assert plans["passage-texts-once"][1] < plans["passage-windows"][1] < plans["passage-pairs"][1] < plans["passage-bridging"][1]
