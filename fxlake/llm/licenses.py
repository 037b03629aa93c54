"""License scans by patience alignment.

A template is aligned with a stretch of text: words that are unique in both are matched, the longest increasing
subsequence of their places are anchors, and the gaps between anchors (and the text near the outer ones) are
aligned in the same way, down to common prefixes and suffixes. A gap without unique words takes all pairs of equal
words, whose longest increasing subsequence is the gap's longest common subsequence. The share of the template's
words that are matched is its coverage; a stretch of at most SPREAD template lengths with coverage of at least 0.8 is a find.

A text is only aligned with templates of whose words, each counted as often as the template has it, it knows at
least 0.8 (fewer can't reach that coverage). Words that the template doesn't have can't match, so windows are cut over
the others alone: any number of foreign words may stand between two words of a find, as long as the whole stretch
keeps to SPREAD. Windows of one and a half template lengths, half a length apart, find repeated notices each; where a
text repeats the template's own words in between, windows of three lengths do. Of overlapping finds of a template the
one with the highest coverage stays (the first, among equals); templates that are like each other are each found.
Null and empty texts have no find; templates without words never match. Texts are read whole; repeated rows get equal results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.llm.common import bounded_batches, read_table, text_or_empty
from fxlake.llm.license_texts import NOTICES

COVERAGE = 0.8
#: Template lengths that a find may stretch over, foreign words included.
SPREAD = 3
#: Lengths of windows, in template lengths, over the words that the template has.
WINDOWS = (1.5, 3)
_WORDS = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back[i] = piles[p - 1] if p else -1
        tops[p:p + 1] = [v]
        piles[p:p + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(text: list[str], a: int, b: int, template: list[str], c: int, d: int) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: increasing among all pairs of equal words, a word's later places first."""
    there: dict[str, list[int]] = {}
    for j in range(d - 1, c - 1, -1):
        there.setdefault(template[j], []).append(j)
    pairs = [(i, j) for i in range(a, b) for j in there.get(text[i], ())]
    return [pairs[k] for k in increasing([j for _, j in pairs])]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (in the text, in the template), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template), True, True)]
    while todo:
        a, b, c, d, open_left, open_right = todo.pop()
        while not open_left and a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while not open_right and a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once = {w for w, n in Counter(text[a:b]).items() if n == 1} & {w for w, n in Counter(template[c:d]).items() if n == 1}
        if not once:
            out += _common(text, a, b, template, c, d)
            continue
        at = {text[i]: i for i in range(a, b) if text[i] in once}
        pairs = [(at[template[j]], j) for j in range(c, d) if template[j] in once]
        anchors = [pairs[k] for k in increasing([i for i, _ in pairs])]
        out += anchors
        first, last = anchors[0], anchors[-1]
        todo.append((a, first[0], c, first[1], open_left, False))
        todo.append((last[0] + 1, b, last[1] + 1, d, False, open_right))
        todo += [(i + 1, k, j + 1, m, False, False) for (i, j), (k, m) in zip(anchors, anchors[1:], strict=False)]
    return sorted(out)


def _densest(places: list[int], most: int) -> tuple[int, int]:
    """[first, end) of the most places that lie within `most` words of text, the first such."""
    best, low = (0, 0), 0
    for high in range(1, len(places) + 1):
        while places[high - 1] - places[low] >= most:
            low += 1
        if high - low > best[1] - best[0]:
            best = (low, high)
    return best


def scan_text(words: list[str], templates: dict[str, tuple[list[str], Counter[str]]]) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, last word) of each find."""
    have, out = set(words), []
    for name, (template, counts) in templates.items():
        least = COVERAGE * len(template)
        if not template or sum(counts[w] for w in have & counts.keys()) < least:
            continue
        places = [i for i, w in enumerate(words) if w in counts]
        own = [words[i] for i in places]
        finds = []
        step = max(1, len(template) // 2)
        for size in (max(2, int(len(template) * times)) for times in WINDOWS):
            for at in range(0, max(1, len(own) - size + step), step):
                part = own[at : at + size]
                # as often as the template has them: more can't match
                if sum((Counter(part) & counts).values()) < least:
                    continue
                matched = [places[at + i] for i, _ in align(part, template)]
                first, end = _densest(matched, SPREAD * len(template))
                if end - first >= least:
                    finds.append(((end - first) / len(template), -matched[first], matched[end - 1]))
        taken: list[tuple[int, int]] = []
        for coverage, first, last in sorted(finds, key=lambda f: (-f[0], f[2] + f[1], -f[1], f[2])):
            if all(last < s or -first > e for s, e in taken):
                taken.append((-first, last))
                out.append((name, coverage, -first, last))
    return sorted(out, key=lambda f: (f[2], f[0]))


FOUND = "array<struct<license:string,coverage:double,first_word:int,last_word:int>>"


def scan_licenses(df: DataFrame, notices: dict[str, str] = NOTICES, text: str = "text", out: str = "licenses") -> DataFrame:
    """Add the finds of all templates in the whole text. Other columns stay."""
    bounded_batches(df.sparkSession)
    templates = {name: (words := words_of(notice), Counter(words)) for name, notice in notices.items()}

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("license", "coverage", "first_word", "last_word")
        for texts in batches:
            yield pd.Series([[dict(zip(names, f, strict=True)) for f in scan_text(words_of(t), templates)] for t in texts], dtype=object)

    return df.withColumn(out, found(text_or_empty(text)))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word of every find in every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs).select("doc_id", F.explode("licenses").alias("f"))
    return found.select("doc_id", "f.license", F.round("f.coverage", 6).alias("coverage"), "f.first_word", "f.last_word")
