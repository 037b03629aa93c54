"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts are canonicalised into templates: numbers, names (a capitalised word after a word, a comma or a semicolon)
and units (after a number) become typed placeholders; other words are lower-cased and lose punctuation. Every
window of five template tokens of a document is hash-joined with the windows of the benchmark items. A pair of
document and item is a candidate if at least 0.8 of the item's windows are found. Then slots are checked: along
one alignment, each value of the item must stand for one value of the document and the other way round, within a
type. Every alignment that reaches 0.8 by itself is checked, and the most frequent one in any case; if one of them
passes, the pair is a leak, also where all values differ (a re-parameterised question). The figures are those of the
passing alignment with most windows (the earliest, among equals).

The benchmark's windows are broadcast up to BROADCAST_WINDOWS (their number is counted first); a larger benchmark
is joined by a shuffle on the hash. Null and empty texts, and items of fewer than five tokens, have no window and
match nothing. Rows that repeat an id and a text are one document or item; documents that repeat an id with other texts
are judged apart, and the best one counts. Null ids are passed over, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fxlake.llm.common import materialize, read_table, text_or_empty

WINDOW, COVERAGE = 5, 0.8
BROADCAST_WINDOWS, BROADCAST_IDS = 500_000, 1_000_000
NUMBER, NAME, UNIT, POINT = "\u0001", "\u0002", "\u0003", "\u0004"
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|ft|in|mi|mile|miles|l|ml|s|sec|second|seconds|min|minute|minutes|h|hour|hours|day|days|week|weeks|month|months|year|years|dollar|dollars|euro|euros|percent|meter|meters"
#: (pattern, replacement) in order. They mark, and the last one splits tokens by one space each.
STEPS = (
    (r"(\d)[.,](\d)", rf"$1{POINT}$2"),
    (rf"(\d[\d{POINT}]*)", rf" {NUMBER}$1 "),
    (rf"({NUMBER}[\d{POINT}]+ +)({UNITS})\b", rf"$1{UNIT}$2"),
    (r"([\p{L},;] )(\p{Lu}\p{Ll}+)", rf"$1{NAME}$2"),
    (rf"[^\p{{L}}\p{{N}}{NUMBER}-{POINT}]+", " "),
)


def surface(text: Column) -> Column:
    """Marked tokens, one space between: a placeholder's mark is followed by its value."""
    for pattern, replacement in STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(F.lower(text))


def template(marked: Column) -> Column:
    """The same tokens with the values of placeholders left out."""
    return F.regexp_replace(marked, f"([{NUMBER}-{UNIT}])[^ ]+", "$1")


def _windows(marked: DataFrame, key: str, place: str) -> DataFrame:
    """(key, place, window): the hash of each window and its first token's place. Each step is a projection of its
    own, so that nothing is worked out again for every window."""
    tokens = marked.select(key, F.transform(F.split(template(F.col("marked")), " "), lambda t: F.xxhash64(t)).alias("tokens")).where(F.size("tokens") >= WINDOW)
    places = F.sequence(F.lit(0), F.size("tokens") - WINDOW)
    hashed = F.transform(places, lambda i: F.xxhash64(*[F.get(F.col("tokens"), i + k) for k in range(WINDOW)]))
    return tokens.select(key, F.posexplode(hashed).alias(place, "window"))


def _marked(table: DataFrame, key: str, text: str, name: str) -> DataFrame:
    return table.where(F.col(key).isNotNull()).select(F.col(key).alias(name), surface(text_or_empty(text)).alias("marked"))


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text) that ids has, each text of an id once. Ids go to the documents up to a counted
    bound, so that only the texts wanted are shuffled."""
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, n_slots, n_changed) of each leak; n_changed slots have other values."""
    items = _marked(benchmark, item_id, item_text, "item_id").dropDuplicates(["item_id", "marked"])
    items = materialize(items, "items")
    of_items = materialize(_windows(items, "item_id", "item_place").distinct(), "item-windows")
    totals = of_items.groupBy("item_id").agg(F.countDistinct("item_place").alias("n_windows"))
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    # rows that repeat an id and a text are one document; those that repeat an id with other texts are judged apart
    marked = docs.select(F.struct("doc_id", F.xxhash64("text").alias("row")).alias("doc"), surface(F.col("text")).alias("marked"))
    of_docs = _windows(marked, "doc", "place")
    side = F.broadcast(of_items) if of_items.count() <= BROADCAST_WINDOWS else of_items
    found = of_docs.join(side, "window").select("doc", "item_id", "item_place", (F.col("place") - F.col("item_place")).alias("shift"))
    shifts = found.groupBy("doc", "item_id", "shift").agg(F.collect_set("item_place").alias("places"))
    pairs = shifts.groupBy("doc", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_matched"),
        F.collect_list(F.struct(F.size("places").alias("n"), (-F.col("shift")).alias("back"), "places")).alias("alignments"),
    )
    enough = lambda n: n >= COVERAGE * F.col("n_windows")
    candidates = pairs.join(totals, "item_id").where(enough(F.col("n_matched"))).withColumn("best", F.array_max("alignments"))
    tried = F.filter("alignments", lambda a: enough(a["n"]) | (a["back"] == F.col("best.back")))
    candidates = candidates.select("doc", "item_id", "n_windows", "n_matched", F.explode(tried).alias("tried"))
    candidates = candidates.select("doc", "item_id", "n_windows", "n_matched", F.col("tried.n").alias("n"), (-F.col("tried.back")).alias("shift"), F.col("tried.places").alias("places"))
    candidates = materialize(candidates, "candidates")
    return _consistent(candidates, docs, items)


def _consistent(candidates: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of which a candidate alignment has consistent slots. Of documents that share an id the best one counts."""
    token = lambda c, i: F.get(F.split(c, " "), i)
    covered = candidates.select("doc", "item_id", "shift", F.explode(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + WINDOW - 1))))).alias("at"))
    slots = covered.join(items, "item_id").select("doc", "item_id", "shift", "at", token("marked", F.col("at")).alias("own"))
    slots = slots.where(F.substring("own", 1, 1).isin(NUMBER, NAME, UNIT))
    places = slots.groupBy("doc").agg(F.collect_list(F.struct("item_id", "shift", "at", "own")).alias("slots"))
    marked = _wanted(docs, candidates.select("doc.doc_id").distinct()).select(F.struct("doc_id", F.xxhash64("text").alias("row")).alias("doc"), surface(F.col("text")).alias("marked"))
    values = marked.join(places, "doc").select("doc", F.split("marked", " ").alias("tokens"), F.explode("slots").alias("s"))
    values = values.select("doc", "s.item_id", "s.shift", "s.own", F.get("tokens", F.col("s.at") + F.col("s.shift")).alias("theirs"))
    kind = F.substring("own", 1, 1)
    judged = values.groupBy("doc", "item_id", "shift").agg(
        F.count("*").alias("n_slots"),
        F.sum((F.col("own") != F.col("theirs")).cast("long")).alias("n_changed"),
        F.countDistinct("own", "theirs").alias("both"),
        F.countDistinct("own").alias("own"),
        F.countDistinct(kind, "theirs").alias("theirs"),
    )
    passed = candidates.join(judged, ["doc", "item_id", "shift"], "left").where("both is null or (both = own and both = theirs)")
    first = F.max(F.struct("n", -F.col("shift"), "n_windows", "n_matched", "n_slots", "n_changed")).alias("first")
    out = passed.groupBy("doc.doc_id", "item_id").agg(first).select("doc_id", "item_id", "first.*")
    return out.select(
        "doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("n_matched").cast("long").alias("n_matched"),
        F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"),
    )


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The leaks of all benchmark items in all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def _sql_surface() -> str:
    out = "coalesce(text, '')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, replacement in STEPS:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(replacement.replace('$', chr(92)))}, 'g')"
    return f"trim(lower({out}))"


OP7_SQL = f"""
with docs as (select distinct struct_pack(doc_id := doc_id, row := hash(coalesce(text, ''))) as id, string_split({_sql_surface()}, ' ') as tokens from documents where doc_id is not null),
items as (select distinct struct_pack(doc_id := item_id, row := 0::ubigint) as id, string_split({_sql_surface()}, ' ') as tokens from benchmark where item_id is not null),
plain as (
  select 'd' as side, id, tokens, list_transform(tokens, lambda t: case when t[1] in ('{NUMBER}', '{NAME}', '{UNIT}') then t[1] else t end) as shapes from docs
  union all
  select 'i', id, tokens, list_transform(tokens, lambda t: case when t[1] in ('{NUMBER}', '{NAME}', '{UNIT}') then t[1] else t end) from items),
cut as (select side, id, tokens, shapes, unnest(range(1, len(shapes) - {WINDOW} + 2)) as p from plain),
wins as (select side, id, p, array_to_string(shapes[p:p + {WINDOW - 1}], ' ') as w from cut),
item_wins as (select distinct id as item_id, p as item_p, w from wins where side = 'i'),
totals as (select item_id, count(distinct item_p) as n_windows from item_wins group by 1),
found as (select distinct a.id as doc_id, b.item_id, b.item_p, a.p - b.item_p as shift from wins a join item_wins b using (w) where a.side = 'd'),
shifts as (select doc_id, item_id, shift, count(*) as n from found group by 1, 2, 3),
pairs as (select doc_id, item_id, count(distinct item_p) as n_matched from found group by 1, 2),
ranked as (select *, row_number() over (partition by doc_id, item_id order by n desc, shift) as r from shifts),
cand as (
  select doc_id, item_id, n_windows, n_matched, shift, n from pairs join totals using (item_id) join ranked using (doc_id, item_id)
  where n_matched >= {COVERAGE} * n_windows and (n >= {COVERAGE} * n_windows or r = 1)),
places as (select distinct doc_id, item_id, shift, item_p + k as pos from found join cand using (doc_id, item_id, shift), range({WINDOW}) r(k)),
slots as (
  select doc_id, item_id, shift, i.tokens[pos] as own, d.tokens[pos + shift] as theirs
  from places join items i on i.id = item_id join docs d on d.id = doc_id where i.tokens[pos][1] in ('{NUMBER}', '{NAME}', '{UNIT}')),
judged as (
  select doc_id, item_id, shift, count(*) as n_slots, sum(case when own <> theirs then 1 else 0 end) as n_changed, count(distinct (own, theirs)) as both_,
    count(distinct own) as own_, count(distinct (own[1], theirs)) as theirs_
  from slots group by 1, 2, 3)
select doc_id.doc_id as doc_id, item_id.doc_id as item_id, n_windows, n_matched, coalesce(n_slots, 0)::bigint as n_slots, coalesce(n_changed, 0)::bigint as n_changed
from cand left join judged using (doc_id, item_id, shift) where both_ is null or (both_ = own_ and both_ = theirs_)
qualify row_number() over (partition by doc_id.doc_id, item_id order by n desc, shift, n_windows desc, n_matched desc, n_slots desc, n_changed desc) = 1
"""
