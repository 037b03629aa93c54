"""Fuzzy line deduplication with DataFrame functions only.

1. Lines are cut at line feeds and normalised: lower case, every run of other characters than letters and digits
   becomes one space. Lines that normalise to nothing are always kept and never compared.
2. Equal normalised lines are one node (its id is a 64-bit hash of their words).
3. Pigeonhole: the features of a line are its words, and in lines of under four words their runs of three characters
   as well. The SKETCH longest ones (ties by hash) are its sketch, and each choice of SHARED of them is a key. An edit
   that changes up to SKETCH - SHARED of the features leaves one key, whatever the length of the line.
4. Nodes that share a key are candidates if their lengths are within a fifth of the longer, the SimHashes of their
   words are within MAX_BITS bits and no more than MAX_PIECES of their words are edited (lines of up to SHORT characters
   need only the lengths). Candidates are linked if their edit similarity, over all characters, is 0.8 or more.
5. First round: in each key a node meets the key's smallest node and its neighbour, in the order of ids (linear).
   Links make components. Second round: where a key still holds several components, the nodes outside its largest one
   meet all nodes of other components, in cells of at most BLOCK by BLOCK nodes that are compared inside arrays; only
   pairs of components that are linked leave a cell. So no candidate pair between different components is left out.
6. Of each component the first occurrence, by document id and line number, stays.

Blocks of the SimHash itself can't serve as keys: one changed letter moves it by more than the three bits that blocks
of a useful width allow for, unless the line is very long.

Null and empty texts have no line to drop. Rows with a null id are left as they are. Rows that repeat an id and a text
are treated alike, as one document; rows that repeat an id with other texts are documents of their own. Columns other
than the text stay; n_lines and n_dropped take other names (`counts`) where the input has columns of these names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fxlake.llm.common import materialize, read_table, release, small_enough, text_or_empty
from fxlake.llm.components import connected_components

SIMILARITY = 0.8
#: Features of a sketch, and those of one key. Any two changed features of five leave a key.
SKETCH, SHARED = 5, 3
#: Greatest Hamming distance of the SimHashes of candidates. With a fifth of the words replaced they are 13 bits apart,
#: with a deviation of three, with a tenth 9; lines that share half of their words are 21, unrelated ones 32 apart.
MAX_BITS, SHORT = 22, 40
#: Characters of a piece of a word (its end counts as one), and the share of pieces that candidates may differ in.
PIECE, MAX_PIECES = 8, 0.35
#: Characters of a fine piece, and the pieces up to which common ends aren't worth seeking.
FINE, FEW_PIECES = 4, 96
#: Nodes on either side of a cell of the second round.
BLOCK = 512
#: What a side of a join may have in bytes to be broadcast; it is measured, and shuffled beyond.
BROADCAST_BYTES = 32 << 20

#: Words of so many characters are looked at first: where a line has SKETCH of them, they make its sketch.
LONG = 8

BREAKS = r"[^\p{L}\p{N}]+"
#: Runs of them within lines, but for single spaces. (Naming a-z saves looking up what kind of character each is.)
RUNS = r" [^a-z0-9\p{L}\p{N}\n]+|[^a-z0-9\p{L}\p{N}\n ][^a-z0-9\p{L}\p{N}\n]*"


def words_of(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, BREAKS), "")


def normalized(line: Column) -> Column:
    return F.array_join(words_of(F.lower(line)), " ")


def _feature(word: Column) -> Column:
    """A hash whose order is that of decreasing length."""
    length = F.least(F.char_length(word), F.lit(63)).cast("bigint")
    return F.shiftleft(F.lit(63).cast("bigint") - length, 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 7))


def occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, line_no, id, n, s0, s1, ...) of every line that can be compared: hash of its text, line number,
    hash of its words, length, sketch."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    # rows that repeat an id and a text give the same lines twice, and the same places
    clean = F.regexp_replace(F.lower("text"), RUNS, " ")
    lines = rows.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split(clean, "\n")).alias("line_no", "line"))
    norm = lines.select("doc_id", "row", "line_no", F.trim("line").alias("norm")).where("norm <> ''")
    words = norm.select("*", F.split("norm", " ").alias("words"))
    words = words.select("*", F.array_distinct(F.filter("words", lambda w: F.char_length(w) >= LONG)).alias("long"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("norm") - 2, F.lit(1))), lambda i: _feature(F.substring(F.col("norm"), i, F.lit(3))))
    features = F.transform(F.when(F.size("long") >= SKETCH, F.col("long")).otherwise(F.col("words")), _feature)
    features = F.when(F.size("words") < 4, F.concat(features, runs)).otherwise(features)
    sketch = F.slice(F.sort_array(F.array_distinct(features)), 1, SKETCH)
    out = words.select("doc_id", "row", "line_no", F.xxhash64("norm").alias("id"), F.char_length("norm").alias("n"), sketch.alias("sketch"))
    return out.select("doc_id", "row", "line_no", "id", "n", *[F.get("sketch", i).alias(f"s{i}") for i in range(SKETCH)])


def _keys() -> Column:
    """The keys of a sketch: those of its choices that it has."""
    return F.array_compact(F.array(*[F.when(F.col(f"s{chosen[-1]}").isNotNull(), F.xxhash64(*[f"s{i}" for i in chosen])) for chosen in combinations(range(SKETCH), SHARED)]))


def simhashes(texts: DataFrame) -> DataFrame:
    """(id, simhash) of texts(id, norm). A bit is set if more than half of the words' hashes have it.

    Words are counted by a hash aggregate of 32 sums, each of which counts two bits.
    """
    words = texts.select("id", F.explode(F.split("norm", " ")).alias("word")).select("id", F.xxhash64("word").alias("h"))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(0x0000000100000001))).alias(f"s{j}") for j in range(32)]
    sums = words.groupBy("id").agg(F.count("*").alias("n"), *lanes)

    def bit(b: int) -> Column:
        count = F.shiftrightunsigned(f"s{b % 32}", 32 * (b // 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(count * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("bigint"))

    return sums.select("id", reduce(Column.bitwiseOR, map(bit, range(64))).alias("simhash"))


def _lengths_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * SIMILARITY - 1e-9


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _common_ends(a: Column, b: Column, shorter: Column) -> Column:
    """Struct of the characters that two texts have in common at their starts (p) and, of the rest, at their ends (s).
    Both are searched by halving steps, each a comparison of substrings."""
    steps = F.transform(F.sequence(F.floor(F.log2(shorter)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    starts = F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.substring(a, p + 1, s) == F.substring(b, p + 1, s), p + s).otherwise(p))
    ends = F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.right(a, p + s) == F.right(b, p + s), p + s).otherwise(p))
    return _let(F.least(starts, shorter), lambda p: F.struct(p.alias("p"), F.least(ends, shorter - p).alias("s")))


def _pieces(text: Column, size: int) -> Column:
    """The words of a text and the spaces after them, cut into pieces of up to `size` characters: a hash of 15 bits and
    a half each, as characters of a string (those from U+1000 to U+D7FF), so that Spark's edit distance applies to them."""
    cut = F.regexp_extract_all(F.concat(text, F.lit(" ")), F.lit(f"[^ ]{{0,{size - 1}}} |[^ ]{{{size}}}"), F.lit(0))
    symbols = F.transform(cut, lambda piece: F.hex(F.pmod(F.xxhash64(piece), F.lit(0xC800)) + 0x1000))
    return F.decode(F.unhex(F.array_join(symbols, "")), "UTF-16BE")


def comparable(norm: Column) -> list[Column]:
    """What edit similarity needs of a line: its length, its characters, and its pieces."""
    return [F.char_length(norm).alias("n"), norm.alias("norm"), _pieces(norm, PIECE).alias("pieces")]


def _unlike(a: Column, b: Column, then) -> Column:
    """then(struct of one, two, longest): the parts of two texts between their common ends."""
    shorter = F.least(F.char_length(a), F.char_length(b))
    between = lambda side, ends: F.substring(side, ends["p"] + 1, F.char_length(side) - ends["p"] - ends["s"])
    longest = lambda ends: F.greatest(F.char_length(a), F.char_length(b)) - ends["p"] - ends["s"]
    parts = _let(_common_ends(a, b, shorter), lambda ends: F.struct(between(a, ends).alias("one"), between(b, ends).alias("two"), longest(ends).alias("longest")))
    return _let(parts, then)


def _piece_distance(a: Column, b: Column, most: Column) -> Column:
    """Edit distance of pieces, -1 beyond `most`. It is that of the parts between common ends; these are sought in long lines."""
    distance = lambda x, y: F.call_function("levenshtein", x, y, most)
    return F.when(F.greatest(F.char_length(a), F.char_length(b)) <= FEW_PIECES, distance(a, b)).otherwise(_unlike(a, b, lambda parts: distance(parts["one"], parts["two"])))


def _edits_within(a: Column, b: Column, most: Column) -> Column:
    """Whether the edit distance of two texts is `most` at most, by what bounds it first: the length of what lies between
    the common start and the common end, then the distance of that in fine pieces, each of which is worth FINE characters."""
    fine = lambda parts: F.call_function("levenshtein", _pieces(parts["one"], FINE), _pieces(parts["two"], FINE), _few(most, FINE)) >= 0
    exact = lambda parts: F.call_function("levenshtein", parts["one"], parts["two"], most) >= 0  # noqa: E731  -1 beyond `most`
    return _unlike(a, b, lambda parts: (parts["longest"] <= most) | ((parts["longest"] > SHORT) & (_few(most, FINE) >= 0) & fine(parts)) | exact(parts))


def _few(most: Column, size: int) -> Column:
    """Pieces whose edits come to `most` characters, less one, for two unlike pieces with one hash."""
    return F.floor(most / size).cast("int") - 1


def _most_edits(a: Column, b: Column, similarity: float) -> Column:
    return F.floor(F.greatest(a["n"], b["n"]) * (1 - similarity) + 1e-9).cast("int")


def edit_similar(a: Column, b: Column, similarity: float = SIMILARITY) -> Column:
    """1 - distance / longer length >= similarity of two structs of `comparable`."""
    longer, shorter = F.greatest(a["n"], b["n"]), F.least(a["n"], b["n"])
    within = _edits_within(a["norm"], b["norm"], _most_edits(a, b, similarity))
    return F.when((shorter < longer * similarity - 1e-9) | (shorter < 1), F.lit(False)).otherwise(within)


def candidates(a: Column, b: Column) -> Column:
    """Whether two nodes that share a key, structs of `comparable` and simhash, may be similar by lengths and SimHashes."""
    near = F.bit_count(a["simhash"].bitwiseXOR(b["simhash"])) <= MAX_BITS
    return _lengths_fit(a["n"], b["n"]) & ((F.greatest(a["n"], b["n"]) <= SHORT) | near)


def linked(a: Column, b: Column) -> Column:
    """Whether two candidates differ in few pieces, or are short, and are similar. Edit distance of characters is dear:
    the distance in pieces, each worth PIECE characters at most, settles most pairs."""
    most = _most_edits(a, b, SIMILARITY)
    within = _edits_within(a["norm"], b["norm"], most)
    pieces = F.floor(F.greatest(F.char_length(a["pieces"]), F.char_length(b["pieces"])) * MAX_PIECES).cast("int")
    near = _let(_piece_distance(a["pieces"], b["pieces"], pieces), lambda d: (d >= 0) & ((d <= _few(most, PIECE)) | within))
    return F.when(F.greatest(a["n"], b["n"]) <= SHORT, within).otherwise(near)


def _merged(df: DataFrame) -> DataFrame:
    """To be joined by sorting. Spark would broadcast small tables, which the driver builds; the joins here are many."""
    return df.hint("merge")


def _broadcast_if_small(df: DataFrame, bytes_a_row: Column) -> DataFrame:
    return F.broadcast(df) if small_enough(df, bytes_a_row, BROADCAST_BYTES) else df


def _lines(wanted: DataFrame, lines: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, line: struct of n, norm, simhash) of the nodes wanted(id), from the documents of their first occurrences."""
    first = lines.join(_merged(wanted), "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("p"))
    places = first.groupBy("p.doc_id", "p.row").agg(F.collect_list(F.struct("p.line_no", "id")).alias("places"))
    places = materialize(places.toDF("doc_id", "row", "places"), "line-places")
    own = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("row", F.xxhash64("text"))
    own = own.join(_broadcast_if_small(places, F.size("places") * 16 + 48), ["doc_id", "row"])
    own = own.select(F.split("text", "\n").alias("lines"), "places").select("lines", F.explode("places").alias("p"))
    texts = own.select("p.id", normalized(F.get("lines", F.col("p.line_no"))).alias("norm")).dropDuplicates(["id"])
    texts = materialize(texts, "line-texts")
    both = texts.join(_merged(simhashes(texts)), "id").select("id", F.struct(*comparable(F.col("norm")), "simhash").alias("line"))
    out = materialize(both, "line-candidates")
    release(places, texts)
    return out


def _tasks(df: DataFrame) -> int:
    """For joins whose rows are few, but dear: Spark would join their partitions by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _first_links(met: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): linked nodes among those that are the first of a key or neighbours in it."""
    some = [met.where(_lengths_fit(F.col(f"{other}.n"), F.col("n"))).select(F.least("id", f"{other}.id").alias("a"), F.greatest("id", f"{other}.id").alias("b")) for other in ("leader", "previous")]
    one, two = (texts.select(F.col("id").alias(c), F.col("line").alias(f"line_{c}")) for c in "ab")
    tasks = _tasks(met)
    pairs = some[0].union(some[1]).where("a <> b").distinct().join(_merged(one), "a").repartition(tasks, "b").join(_merged(two.repartition(tasks, "b")), "b")
    a, b = F.col("line_a"), F.col("line_b")
    return pairs.where(candidates(a, b)).where(linked(a, b)).select("a", "b")


def _bridges(met: DataFrame, texts: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): linked components, of nodes that share a key."""
    large = met.where("place > 3").select("key").distinct()  # in smaller keys all have met
    crowd = met.join(_merged(large), "key", "left_semi")
    members = crowd.select("key", "id").union(crowd.where("place = 2").select("key", "leader.id"))
    members = members.join(_merged(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("size"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    shape = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all")).where("all > top.size")
    shape = shape.select("key", F.col("top.component").alias("main"), blocks(F.col("all")).alias("columns"), blocks(F.col("all") - F.col("top.size")).alias("rows"))
    sketches = nodes.select("id", F.array_compact(F.array(*[f"s{i}" for i in range(SKETCH)])).alias("sketch"))
    members = members.join(_merged(shape), "key").join(_merged(texts), "id").join(_merged(sketches), "id")
    place = lambda c: F.pmod(F.xxhash64("id", "key"), F.col(c)).cast("int")
    node = F.struct("id", "component", "line.n", "line.norm", "line.pieces", "line.simhash", "sketch")
    few = members.where("component <> main").select("key", place("rows").alias("row"), "columns", "main", node.alias("node")).groupBy("key", "row").agg(F.first("columns").alias("columns"), F.first("main").alias("main"), F.collect_list("node").alias("few"))
    few = few.select("key", "row", "main", "few", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    every = members.select("key", place("columns").alias("column"), node.alias("node")).groupBy("key", "column").agg(F.collect_list("node").alias("every"))

    def bridge(a: Column, b: Column) -> Column:
        # two of the few meet once; a node of the main component is only ever on the right
        apart = (a["component"] != b["component"]) & ((b["component"] == F.col("main")) | (a["id"] < b["id"]))
        # of the keys that they share, they meet in the first
        both = lambda shared: F.xxhash64(*[F.get(shared, i) for i in range(SHARED)]) == F.col("key")
        return apart & candidates(a, b) & _let(F.array_intersect(a["sketch"], b["sketch"]), both) & linked(a, b)

    found = F.flatten(F.transform("few", lambda a: F.array_distinct(F.transform(F.filter("every", lambda b: bridge(a, b)), lambda b: F.struct(F.least(a["component"], b["component"]).alias("a"), F.greatest(a["component"], b["component"]).alias("b"))))))
    cells = few.repartition(_tasks(met), "key", "column").join(_merged(every.repartition(_tasks(met), "key", "column")), ["key", "column"])
    return cells.select(F.explode(found).alias("pair")).select("pair.*").distinct()


def line_components(docs: DataFrame, lines: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component) of the nodes that are linked to another one; lines are the occurrences in docs."""
    sketch = [f"s{i}" for i in range(SKETCH)]
    keyed = lines.groupBy("id").agg(F.min("n").alias("n"), *[F.min(s).alias(s) for s in sketch]).select("id", "n", F.explode(_keys()).alias("key"))
    order = Window.partitionBy("key").orderBy("id")
    named = [f(F.struct("id", "n")).over(order).alias(name) for name, f in (("leader", F.first), ("previous", F.lag))]
    met = materialize(keyed.select("key", "id", "n", *named, F.row_number().over(order).alias("place")).where("previous is not null"), "line-met")
    wanted = met.select("id").union(met.where("place = 2").select("leader.id")).distinct()
    texts = _lines(wanted, lines, docs, doc_id, text)
    nodes = lines.join(_merged(wanted), "id", "left_semi").select("id", *sketch).dropDuplicates(["id"])
    links = materialize(_first_links(met, texts), "line-links")
    labels = materialize(connected_components(links, "line-components").select(F.col("node").alias("id"), "component"), "line-labels")
    bridges = materialize(_bridges(met, texts, nodes, labels), "line-bridges")
    release(met, texts, links)
    if bridges.isEmpty():
        return labels
    # an end of a bridge is a component, or a node that had no link yet
    joined = connected_components(bridges, "line-components").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    known = labels.join(_merged(joined), "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    alone = joined.join(_merged(labels.select("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("whole").alias("component"))
    return known.union(alone)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with `text` less its repeated lines, and the numbers of its lines and of those dropped. Every row stays."""
    lines = materialize(occurrences(docs, doc_id, text), "line-occurrences")
    labels = line_components(docs, lines, doc_id, text)
    placed = lines.select("id", F.struct("doc_id", "row", "line_no").alias("place")).join(_merged(labels), "id", "left").select("place", F.coalesce("component", "id").alias("component"))
    keep = placed.groupBy("component").agg(F.min("place").alias("keep"), F.count("*").alias("n")).where("n > 1")
    repeated = placed.join(_merged(keep), "component").where("place <> keep").select("place.*")
    drops = repeated.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("__drops"))
    drops = materialize(drops.toDF("__doc", "__row", "__drops"), "line-drops")
    release(lines)
    side = _broadcast_if_small(drops, F.size("__drops") * 8 + 48)
    whole = text_or_empty(text)
    out = docs.join(side, (F.col(doc_id) == F.col("__doc")) & (F.xxhash64(whole) == F.col("__row")), "left")
    cut = F.split(F.col(text), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("__drops")), lambda i: F.get(cut, i))
    return out.select(
        *[F.when(F.col("__drops").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(counts[0]),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias(counts[1]),
    )


def op10_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the remaining text of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")
