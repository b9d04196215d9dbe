"""Personal data by weak supervision.

Candidate spans come from patterns. Three labelers vote on each: a regular
expression (strict form or checksum), a gazetteer (known endings, prefixes, ranges)
and the context (words before the span). Expectation-maximisation over the vote
patterns of the whole corpus estimates how far each labeler can be trusted, and a
logistic classifier trained on the resulting probabilities decides on the candidates
beyond the base patterns. Spans of the base patterns always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from strandline.llm.common import small_batches, stored, text_of

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CLASS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where a run of digits starts, so the look-behind changes no match and keeps long runs linear.
DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates beyond the base patterns.
SPELLED = re.compile(r"(?i:(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]?[(\[][ ]?at[ ]?[)\]][ ]?[A-Za-z0-9-]{1,63}(?:(?:[ ]?[(\[][ ]?dot[ ]?[)\]][ ]?|\.)[A-Za-z0-9-]{1,63}){1,6})")
COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:00[1-9]|\([0-9]{2,5}\)|0[0-9]{1,4})[ ./-]?[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,4}(?![0-9A-Za-z.-])")

# Fixed values of the gazetteer and the context labeler.
ENDINGS = frozenset("com org net edu gov mil info biz io de fr es uk eu ch at it nl be pl pt ca us au jp".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
CUES = {
    "email": re.compile(r"(?i)(mail|contact|write|kontakt|courriel|correo)\W{0,3}\w{0,8}\W{0,3}$"),
    "ip": re.compile(r"(?i)(\bip\b|host|server|addr|from|client|node)\W{0,3}\w{0,8}\W{0,3}$"),
    "card": re.compile(r"(?i)(card|visa|master|amex|carte|karte|tarjeta|payment|credit)\W{0,3}\w{0,8}\W{0,3}$"),
    "phone": re.compile(r"(?i)(phone|tel|call|fax|mobile|ruf|t[ée]l|llam)\w{0,5}\W{0,3}\w{0,8}\W{0,3}$"),
}
#: Code points before a span that the context labeler reads.
CONTEXT = 32
SHAPES = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern: from each ``@`` with a domain back over the local part."""
    end, at = 0, text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at)
        if found:
            start = at
            while start > end and text[start - 1] in LOCAL_CLASS:
                start -= 1
            if start < at:
                yield start, found.end()
                end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the four base patterns, kinds in their fixed order."""
    if "@" in text:
        yield from (("email", a, b) for a, b in emails(text))
    for m in DOTTED.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PLUS.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()


def further_candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that the base patterns don't take: spelled-out addresses, long network addresses, short cards, national numbers."""
    if "at" in text or "AT" in text or "At" in text:
        if "(" in text or "[" in text:
            yield from (("email", m.start(), m.end()) for m in SPELLED.finditer(text))
    if ":" in text:
        yield from (("ip", m.start(), m.end()) for m in COLONS.finditer(text))
    for m in DIGITS.finditer(text):
        alone = not (text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum())
        if alone and 13 <= m.end() - m.start() <= 29 and 13 <= len(m[0].replace(" ", "").replace("-", "")) <= 15:
            yield "card", m.start(), m.end()
    yield from (("phone", m.start(), m.end()) for m in NATIONAL.finditer(text))


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, int, int, int]:
    """Votes of the three labelers (1 yes, 0 no, -1 none) and the shape of a span."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        regex, known = int(bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", span))), int(re.split(r"[^A-Za-z0-9]+", span.rstrip(")] "))[-1].lower() in ENDINGS)
    elif kind == "ip":
        regex, known = int(":" in span or not re.search(r"(^|\.)0[0-9]", span)), -1 if ":" in span else int(not span.startswith(("0.", "255.")))
    elif kind == "card":
        regex, known = int(luhn(digits)), int(digits.startswith(CARD_STARTS))
    else:
        regex, known = int(9 <= len(digits) <= 15), int(digits.lstrip("0").startswith(COUNTRIES)) if span.startswith(("+", "00")) else -1
    cue = 1 if CUES[kind].search(text[max(0, start - CONTEXT) : start]) else -1
    inside = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    shape = (3 if inside else 0) + (2 if len(span) > 24 else 1 if len(digits) * 2 > len(span) else 0)
    return regex, known, cue, shape


SPANS = ArrayType(StructType([
    StructField("kind", IntegerType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", BooleanType()),
    StructField("regex", IntegerType()), StructField("known", IntegerType()), StructField("cue", IntegerType()), StructField("shape", IntegerType()),
]))


def candidates(text: str | None) -> list[tuple]:
    """All candidates of a text with their votes; further ones don't overlap base spans of any kind."""
    text = text or ""
    base = list(base_spans(text))
    taken = sorted((a, b) for _, a, b in base)
    out = [(KINDS.index(k), a, b, True, *votes(k, text, a, b)) for k, a, b in base]
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else starts
    ends: dict[str, int] = {}
    for k, a, b in further_candidates(text):
        before = int(np.searchsorted(starts, b)) if taken else 0
        if a >= ends.get(k, 0) and not (before and reach[before - 1] > a):
            ends[k] = b
            out.append((KINDS.index(k), a, b, False, *votes(k, text, a, b)))
    return out


@pandas_udf(SPANS)
def _candidates(texts: pd.Series) -> pd.Series:
    return texts.map(candidates)


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier by feature, and the reliabilities it was trained on."""

    weights: dict[tuple, float]
    reliability: dict[tuple, float]

    def probability(self, kind: int, regex: int, known: int, cue: int, shape: int) -> float:
        z = sum(self.weights.get(f, 0.0) for f in features(kind, regex, known, cue, shape))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(kind: int, regex: int, known: int, cue: int, shape: int) -> list[tuple]:
    return [("bias",), ("kind", kind), ("regex", kind, regex), ("known", kind, known), ("cue", kind, cue), ("shape", shape)]


def expectation_maximisation(votes_: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each vote pattern is true, and each labeler's share of right votes.

    ``votes_`` has a row per pattern and a column per labeler, ``n`` the rows of
    each. Counts of one are added on both sides, so rare patterns stay near the start.
    """
    cast = votes_ >= 0
    yes = votes_ == 1
    p = np.where(cast.any(axis=1), (yes.sum(axis=1) + 0.5) / (cast.sum(axis=1) + 1), 0.5)
    right = np.full(votes_.shape[1], 0.8)
    for _ in range(rounds):
        w1, w0 = n * p, n * (1 - p)
        share = (w1.sum() + 1) / (n.sum() + 2)
        sens = ((w1[:, None] * (yes & cast)).sum(axis=0) + 4) / ((w1[:, None] * cast).sum(axis=0) + 5)
        spec = ((w0[:, None] * (~yes & cast)).sum(axis=0) + 4) / ((w0[:, None] * cast).sum(axis=0) + 5)
        one = np.where(cast, np.where(yes, sens, 1 - sens), 1).prod(axis=1) * share
        zero = np.where(cast, np.where(yes, 1 - spec, spec), 1).prod(axis=1) * (1 - share)
        p = one / (one + zero)
        right = (sens + spec) / 2
    return p, right


def train(patterns: pd.DataFrame) -> Model:
    """EM for each kind, then a logistic span classifier on its probabilities; rows (kind, regex, known, cue, shape, n)."""
    rows, targets, weights, reliability = [], [], [], {}
    for kind, part in patterns.groupby("kind"):
        v = part[["regex", "known", "cue"]].to_numpy()
        p, right = expectation_maximisation(v, part["n"].to_numpy(dtype=float))
        reliability |= {(int(kind), name): float(r) for name, r in zip(("regex", "known", "cue"), right, strict=True)}
        for x, q, n in zip(part[["kind", "regex", "known", "cue", "shape"]].itertuples(index=False), p, part["n"], strict=True):
            rows.append(features(*map(int, x)))
            targets.append(q)
            weights.append(float(n))
    if not rows:
        return Model({}, {})
    names = sorted({f for r in rows for f in r}, key=str)
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r]] = 1
    y, n = np.array(targets), np.array(weights)
    n = n / n.mean()
    w = np.zeros(len(names))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 0.1 * w
        w -= np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 0.1 * np.eye(len(w)), grad)
    return Model(dict(zip(names, w.tolist(), strict=True)), reliability)


def personal_data(docs: DataFrame, accept: float = 0.5) -> tuple[DataFrame, Model]:
    """Rows of ``docs`` as (doc_id, spans) with every accepted span of whole texts, and the model.

    Reads doc_id and text. Null and empty texts have no span; repeated rows are
    independent; an empty table gives no row and an empty model. What reaches the
    driver is the count of each vote pattern, of which there are under 1000 in all.
    """
    small_batches(docs.sparkSession)
    found = stored(docs.select("doc_id", _candidates(text_of()).alias("spans")), "pii-candidates")
    one = found.select(F.explode("spans").alias("s")).select("s.*")
    patterns = one.groupBy("kind", "regex", "known", "cue", "shape").agg(F.count(F.lit(1)).alias("n")).toPandas()
    model = train(patterns.sort_values(["kind", "regex", "known", "cue", "shape"]))
    yes = [key for key in patterns[["kind", "regex", "known", "cue", "shape"]].itertuples(index=False, name=None) if model.probability(*map(int, key)) >= accept]
    key = lambda s: F.concat_ws(",", s["kind"], s["regex"], s["known"], s["cue"], s["shape"])
    known = F.array(*[F.lit(",".join(map(str, k))) for k in yes]).cast("array<string>")
    return found.select("doc_id", F.filter("spans", lambda s: s["base"] | F.array_contains(known, key(s))).alias("spans")), model


def _joined(spans: Column | str) -> Column:
    name = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def spans_by_document(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts by kind, digest of base spans, all spans."""
    rows, _ = personal_data(docs)
    base = F.filter("spans", lambda s: s["base"])
    number = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(number, lambda kind: kind == F.lit(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans"))
