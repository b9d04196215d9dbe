"""Toxicity by compression distance: which of two zstandard dictionaries helps a window more.

One dictionary holds what ordinary text repeats, the other the same and, in place of
some of it, passages of toxic rows around words and beginnings of words that toxic
rows share and ordinary ones don't. A text is read
in overlapping windows; each is compressed with both, and the saved bytes become a
score by thresholds that rows kept from the dictionaries calibrate.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from strandline.llm.common import bounded_sample, held_out, learnable, small_batches, text_of

#: Bound of the training sample: rows of label 1 and 0, and code points of all rows of a label.
TOXIC_ROWS, ORDINARY_ROWS, LABEL_CHARS = 2500, 5000, 40_000_000
#: Share of the sample that only calibrates.
CALIBRATION = 0.4
#: Bytes of a window and of what neighbours share, so that a word lies whole in one of them.
WINDOW, OVERLAP = 40, 16
#: Bytes of the dictionaries' common part and of the part of their own, and zstandard's level.
COMMON, OWN, LEVEL = 8192, 2048, 9
#: A word, or a word's first bytes of these lengths, marks a passage if so many toxic rows have it, and their share is so many times that of the ordinary ones.
STEM, MARK_ROWS, MARK_RATIO = (5, 12), 4, 10.0
#: Bytes of a passage on either side of its marks.
CONTEXT = 12
#: Windows and passages that train one dictionary.
TRAIN_WINDOWS, TRAIN_PASSAGES = 40_000, 8_000
SAVED = (3, 4, 5, 6)
WORDS = re.compile(rb"[a-z\x80-\xff]+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float


def windows(text: str) -> list[bytes]:
    data = text.lower().encode("utf-8")
    step = WINDOW - OVERLAP
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - OVERLAP), step)]


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(text: str | None, ordinary: bytes, toxic: bytes) -> list[float]:
    """What the toxic dictionary saves on a text: best windows, mean, shares of windows by bytes saved, and the text's length."""
    plain, marked = _compressor(ordinary).compress, _compressor(toxic).compress
    parts = windows(text or "")
    saved = np.fromiter((len(plain(w)) - len(marked(w)) for w in parts), dtype=np.int64, count=len(parts))
    best, n = np.sort(saved)[::-1][:4], len(parts)
    shares = [float((saved >= s).sum() / n) for s in SAVED]
    return [float(best[0]), float(best[:2].mean()), float(best.mean()), float(saved.mean()), *shares, *np.sqrt(shares).tolist(), float(np.log1p(n)), float(best.mean() / np.log1p(n + 3))]


def _trained(samples: list[bytes], size: int, segment: int = 16, match: int = 6) -> bytes:
    """The content that zstandard's trainer picks, without its tables; of few samples, their own bytes."""
    try:
        return zstandard.train_dictionary(size + 2000, samples, k=segment, d=match, level=3).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\x00" * 8


def _pick(items: list, most: int, rng: np.random.Generator) -> list:
    return items if len(items) <= most else [items[i] for i in sorted(rng.choice(len(items), most, replace=False))]


def _beginnings(word: bytes) -> list[bytes]:
    """The word, told from beginnings by a blank, and its beginnings."""
    return [word + b" ", *(word[:i] for i in range(STEM[0], min(len(word), STEM[1]) + 1))]


def marks_of(bad: list[str], good: list[str]) -> set[bytes]:
    """Words and beginnings of words that many more toxic than ordinary rows have."""

    def having(text: str) -> set[bytes]:
        return {b for w in set(WORDS.findall(text.lower().encode("utf-8"))) for b in _beginnings(w)}

    in_bad, in_good = Counter(), Counter()
    for t in bad:
        in_bad.update(having(t))
    in_bad = {b: n for b, n in in_bad.items() if n >= MARK_ROWS}
    for t in good:
        in_good.update(having(t) & in_bad.keys())
    return {b for b, n in in_bad.items() if n / len(bad) >= MARK_RATIO * (in_good[b] + 1) / (len(good) + 1)}


def passages_of(text: str, marks: set[bytes]) -> list[bytes]:
    """Stretches of the text around marked words; those that overlap are one."""
    data, spans = text.lower().encode("utf-8"), []
    for m in WORDS.finditer(data):
        if not marks.isdisjoint(_beginnings(m[0])):
            start, end = max(0, m.start() - CONTEXT), m.end() + CONTEXT
            if spans and start < spans[-1][1]:
                spans[-1][1] = end
            else:
                spans.append([start, end])
    return [data[a:b] for a, b in spans]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), grad)
    return w


def train(texts: list[str], toxic: list[int], seed: int = 1) -> Model:
    """Dictionaries and calibration from a bounded sample; repeated texts count once."""
    seen = dict(zip(texts, toxic, strict=True))
    texts, y = list(seen), np.array(list(seen.values()), dtype=float)
    prior = float(y.mean()) if len(y) else 0.0
    if prior in (0.0, 1.0):
        return Model(b"", b"", (), (), (), prior)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    cut = int(len(texts) * (1 - CALIBRATION))
    learn, check = order[:cut], order[cut:]
    if len(set(y[learn])) < 2 or len(set(y[check])) < 2:
        learn = check = order
    bad, good = ([texts[i] for i in learn if y[i] == v] for v in (1, 0))
    marks = marks_of(bad, good)
    passages = _pick([x for t in bad for x in passages_of(t, marks)], TRAIN_PASSAGES, rng)
    plain = [w for t in good for w in windows(t)]
    common = _trained(_pick(plain, TRAIN_WINDOWS, rng), COMMON)
    own = _trained(_pick(plain, TRAIN_WINDOWS, rng), OWN)
    marked = _trained(passages or _pick([w for t in bad for w in windows(t)], TRAIN_WINDOWS, rng), OWN, match=8)
    ordinary, toxic_dict = own + common, marked + common
    x = np.array([features(texts[i], ordinary, toxic_dict) for i in check])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = _logistic(x, y[check])
    # 0.5 is where precision and recall on the calibration rows are best together.
    z = x @ w
    rank = np.argsort(-z)
    hits = np.cumsum(y[check][rank])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y[check].sum())
    k = int(np.argmax(f1))
    w[-1] -= (z[rank[k]] + z[rank[min(k + 1, len(z) - 1)]]) / 2
    return Model(ordinary, toxic_dict, tuple(mean), tuple(scale), tuple(w), prior)


def score(text: str | None, model: Model) -> float:
    if not model.weights:
        return model.prior
    x = (np.array(features(text, model.ordinary, model.toxic)) - model.mean) / model.scale
    return float(1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30))))


def within(ids: pd.DataFrame, most: int) -> pd.DataFrame:
    """Of rows (_id, _toxic, _chars) in order, the ids of each label that fit into ``most`` code points; a longer one is passed over."""
    room, taken = {}, []
    for (label, key), chars in ids.groupby(["_toxic", "_id"], sort=False)["_chars"].sum().items():
        if chars <= room.setdefault(label, most):
            room[label] -= chars
            taken.append((key, label))
    return pd.DataFrame(taken, columns=["_id", "_toxic"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on labelled rows that are not held out: the first of each label in hash order that fit, whole texts."""
    marks = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    rows = docs.filter(learnable(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), text_of().alias("_text"))
    ids = rows.select("_id", F.length("_text").cast("long").alias("_chars")).join(marks, "_id")
    ids = bounded_sample(ids, "_toxic", "_id", F.when(F.col("_toxic") == 1, TOXIC_ROWS).otherwise(ORDINARY_ROWS))
    # The sample has TOXIC_ROWS + ORDINARY_ROWS ids at most, whatever the input.
    ids = within(ids.toPandas().sort_values("_n"), LABEL_CHARS)
    if ids.empty:
        return train([], [])
    ids = docs.sparkSession.createDataFrame(ids, rows.select("_id").schema.add("_toxic", marks.schema["_toxic"].dataType))
    sample = rows.join(F.broadcast(ids), "_id").select("_id", "_text", "_toxic").dropDuplicates().toPandas().sort_values(["_id", "_text"])
    sample = sample.head(TOXIC_ROWS + ORDINARY_ROWS)
    return train(sample["_text"].tolist(), sample["_toxic"].astype(int).tolist())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Scores hang on the text alone, read whole; null texts count as empty and
    get the score of a text in which nothing is saved. Without rows of both labels
    every score is the share of label 1 (0 without labels). Of repeated labels of a
    row the highest counts; labels other than 0 and 1 don't count.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: score(t, model.value)).astype("float64")

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(text_of()).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
