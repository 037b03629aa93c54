"""Personal data by weak supervision.

Base spans are fixed patterns: email, ip, card and phone (see the functions below); they always stay. The method
adds spans: looser patterns propose candidates, and labelers of three sorts vote on each of them -
regular expressions on the span's form, gazetteers of words nearby, and the context around it. Votes are yes, no
or nothing. Candidates with the same votes and features are counted over the whole corpus, expectation-maximisation
over these counts estimates each labeler's reliability and each pattern's posterior, and a logistic span
classifier is trained on features weighted by the posteriors. A candidate becomes a span if the classifier gives
at least 0.5.

Added kinds are `phone` (numbers written without a plus sign), `email` (with the at sign or dots spelled out) and
`secret` (values of keys, tokens and passwords). Positions are code points, ends exclusive. Null and empty texts
have no spans; rows are independent of each other, so repeated rows get equal results. Texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.llm.common import bounded_batches, materialize, read_table, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# The patterns of the contract. The look-behinds only skip starts at which the pattern can't do
# better than from the start of the run of digits, so long runs aren't searched again from each digit.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each at sign back over the local part, then the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    out = [(*span, "email") for span in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---------------------------------------------------------------- candidates, votes and features

_CANDIDATES = (
    ("phone", re.compile(r"(?<![\w.+(-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w-]|\.[0-9])|(?<![\w.+-])1?[0-9]{10}(?![\w-]|\.[0-9])")),
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++(?: ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++| dot [A-Za-z0-9-]++)+|@[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)) ?[A-Za-z0-9-]++| dot [A-Za-z0-9-]++)+)", re.I)),
    ("secret", re.compile(r"(?<=[=:\"' ])[A-Za-z0-9_/+-]{16,}+(?![\w/+-])")),
)
#: Gazetteers: words before a span that speak for a kind.
_WORDS = {
    "phone": frozenset("call phone tel telephone mobile cell fax dial contact whatsapp number".split()),
    "email": frozenset("mail email e-mail contact write reach address".split()),
    "secret": frozenset("password passwd token secret key apikey api_key access_key pwd auth bearer".split()),
}
_AT = re.compile(r"[(\[]at[)\]]|@", re.I)
_BEFORE = re.compile(r"[\w-]+")
LABELERS = ("form", "gazetteer", "assigned", "alone", "variety")
YES, NO, NONE = 1, -1, 0


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """One vote a labeler: the span's form (pattern), words nearby (gazetteer), and the context around it."""
    digits = len(_digits(span))
    if kind == "phone":
        form = YES if 10 <= digits <= 15 and re.search(r"[ .()-]", span) else NO if digits < 8 else NONE
    elif kind == "email":
        form = YES if re.search(r"(?:\.|dot[\])])[ ]?[A-Za-z]{2,}$", span, re.I) else NO
    else:
        form = YES if digits >= 3 and re.search(r"[A-Za-z]", span) else NO
    near = {w.lower() for w in _BEFORE.findall(before)[-3:]}
    gazetteer = YES if near & _WORDS[kind] else NONE
    tail = before.rstrip(" \"'")
    assigned = YES if tail[-1:] in ("=", ":") else NO if kind == "secret" else NONE
    alone = YES if (not after or after[0] in " \n\t,.;)\"'") else NO
    variety = YES if len(set(span)) >= min(8, len(span) // 2) else NO
    return form, gazetteer, assigned, alone, variety


def features(span: str, before: str, after: str) -> tuple[int, ...]:
    """What the span classifier sees beside the votes: a step of the length, character classes, the neighbours' classes."""
    sort = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    has = lambda test: int(any(map(test, span)))
    length = sum(len(span) >= n for n in (12, 16, 24, 40, 80))
    return length, has(str.islower), has(str.isupper), has(str.isdigit), sort(before[-1:]), sort(after[:1])


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple]:
    """(start, end, kind, *votes, *features) of candidates that overlap neither a base span nor an earlier candidate."""
    if not any("0" <= c <= "9" for c in text) and not _AT.search(text):
        return []
    taken, out = [(s, e) for s, e, _ in base], []
    for kind, pattern in _CANDIDATES:
        if kind == "email" and not _AT.search(text):
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if kind == "secret" and not any("0" <= c <= "9" for c in m[0]):
                continue
            if any(s < end and start < e for s, e in taken):
                continue
            taken.append((start, end))
            out.append((start, end, kind, *votes(kind, m[0], (before := text[max(0, start - 40) : start]), (after := text[end : end + 2])), *features(m[0], before, after)))
    return out


SPAN = "struct<start:int,end:int,kind:string>"
FOUND = f"base array<{SPAN}>, candidates array<struct<start:int,end:int,kind:string,votes:string>>"


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `base` spans and voted `candidates` of the whole text. Other columns stay; columns of these names are replaced."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base = base_spans(t)
                names = ("start", "end", "kind")
                rows.append((
                    [dict(zip(names, s, strict=True)) for s in base],
                    [dict(zip((*names, "votes"), (*c[:3], ",".join(map(str, c[3:]))), strict=True)) for c in candidates(t, base)],
                ))
            yield pd.DataFrame(rows, columns=["base", "candidates"])

    return df.withColumn("__found", found(text_or_empty(text))).select(*[F.col(f"`{c}`") for c in df.columns if c not in ("base", "candidates")], "__found.*")


# ---------------------------------------------------------------- reliabilities and the span classifier


@dataclass(frozen=True)
class SpanModel:
    """accept: (kind, votes and features) that become spans; reliability: P(vote is right) of each labeler by kind."""

    accept: frozenset[tuple[str, str]]
    reliability: dict[str, tuple[float, ...]]


def expectation_maximisation(table: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern of votes and accuracy of each labeler, which votes right with its accuracy where it
    votes. Starts from labelers that are right more often than not, with a weak Beta(4, 2) prior that keeps them so."""
    accuracy, prior = np.full(table.shape[1], 0.7), 0.5
    for _ in range(rounds):
        yes = np.log(prior) + np.where(table == YES, np.log(accuracy), np.where(table == NO, np.log(1 - accuracy), 0)).sum(1)
        no = np.log(1 - prior) + np.where(table == NO, np.log(accuracy), np.where(table == YES, np.log(1 - accuracy), 0)).sum(1)
        posterior = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        right = (counts[:, None] * np.where(table == YES, posterior[:, None], np.where(table == NO, 1 - posterior[:, None], 0))).sum(0)
        cast = (counts[:, None] * (table != NONE)).sum(0)
        accuracy = np.clip((right + 4) / (cast + 6), 0.51, 0.99)
        prior = float(np.clip(((counts * posterior).sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
    return posterior, accuracy


def _classifier(table: np.ndarray, seen: np.ndarray, counts: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Logistic regression on one-hot votes and features, each pattern weighted by its count and its posterior either way."""
    one_hot = [seen[:, [j]] == np.unique(seen[:, j]) for j in range(seen.shape[1])]
    x = np.hstack([np.ones((len(table), 1)), table == YES, table == NO, *one_hot]).astype(float)
    w, weight = np.zeros(x.shape[1]), counts / counts.sum() * min(counts.sum(), 1e4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.1 * np.eye(len(w)), x.T @ (weight * (p - posterior)) + 0.1 * w)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def fit(found: DataFrame) -> SpanModel:
    """Learn from the counts of all candidates by kind, votes and features: at most 3 kinds x 3^5 votes x 768 features
    come to the driver (votes follow from the form, so there are some hundreds). Reliabilities come from the votes
    alone; the classifier then learns their posterior from votes and features."""
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").count().collect()
    accept, reliability = set(), {}
    for kind in sorted({r["kind"] for r in rows}):
        own = sorted((r["votes"], r["count"]) for r in rows if r["kind"] == kind)
        table, counts = np.array([[int(v) for v in x.split(",")] for x, _ in own]), np.array([n for _, n in own], float)
        table, seen = table[:, : len(LABELERS)], table[:, len(LABELERS) :]
        posterior, accuracy = expectation_maximisation(table, counts)
        reliability[kind] = tuple(accuracy.tolist())
        accept |= {(kind, x) for (x, _), p in zip(own, _classifier(table, seen, counts, posterior), strict=True) if p >= 0.5}
    return SpanModel(frozenset(accept), reliability)


def with_added(found: DataFrame, model: SpanModel) -> DataFrame:
    """Add `spans`: base spans and accepted candidates by start, then kind."""
    accepted = [f"{kind}|{v}" for kind, v in sorted(model.accept)] or [""]
    chosen = F.filter("candidates", lambda c: F.concat_ws("|", c["kind"], c["votes"]).isin(accepted))
    added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return found.withColumn("spans", F.array_sort(F.concat("base", added), lambda a, b: _order(a, b)))


def _order(a, b):
    rank = lambda s: F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int"), F.lit(9))
    rank_of = lambda s: F.when(rank(s) == 0, 9).otherwise(rank(s))
    by_kind = F.when(rank_of(a) < rank_of(b), -1).when(rank_of(a) > rank_of(b), 1).otherwise(a["end"] - b["end"])
    return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(by_kind)


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = materialize(find(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pii")
    out = with_added(found, fit(found))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
