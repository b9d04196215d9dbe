"""Language identification by the nearest of several centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from strandline.llm.common import held_out, learnable, small_batches, text_of

#: Cells that n-grams of one to three letters are hashed to.
CELLS = 8192
#: Most centroids of a language, and rounds over all training rows that move them.
CENTROIDS, ROUNDS = 4, 4
#: Logarithms of n-grams at which a language's rows are dealt to its first centroids.
STARTS = (10, 12, 14)
#: Components of a vector are summed as whole numbers of this unit, so that no order of rows or tasks changes a sum.
UNIT = float(1 << 24)
#: Steps that cosines are counted in for the rejection limits.
STEPS = 10_000
#: A text is rejected if its cosine is below this share of what training texts of its length have at least (their 1st percentile).
REJECT_SHARE = 0.6
#: Code points taken together while counting a long text.
CHUNK = 1 << 20
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Every code point that is a letter as itself, the others as 0."""
    return np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), dtype=np.uint32, count=0x110000)


def _codes(text: str) -> np.ndarray:
    """A 0 and the code points of a text in small letters, those that are no letters as 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.zeros(len(codes) + 1, dtype=np.uint32)
    letters[1:] = _letters()[codes]
    return letters


def _grams(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of one, two and three neighbours; a single 0 has the hash 0."""
    one = letters * np.uint32(MULTIPLIERS[0])
    two = (one[:-1] ^ (letters[1:] * np.uint32(MULTIPLIERS[1]))) * np.uint32(MULTIPLIERS[2])
    three = (two[:-1] ^ one[2:]) * np.uint32(MULTIPLIERS[1])
    return one, two, three


SHIFT = np.uint32(32 - 13)


def _kept(letters: np.ndarray) -> np.ndarray:
    """Where a letter stands, or the first 0 of a run."""
    keep = letters != 0
    keep[1:] |= keep[:-1].copy()
    keep[0] = True
    return keep


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Cells of letter n-grams, words bounded by blanks, with their counts; None without a letter."""
    if not text:
        return None
    counts = np.zeros(CELLS, dtype=np.int64)
    any_letter = False
    for i in range(0, len(text), CHUNK):
        letters = _codes(text[i : i + CHUNK])
        letters = letters[_kept(letters)]
        if len(letters) == 1:
            continue
        any_letter = True
        if letters[-1]:
            letters = np.append(letters, np.uint32(0))
        counts += np.bincount(np.concatenate(_grams(letters)) >> SHIFT, minlength=CELLS)
        counts[0] -= len(letters) - np.count_nonzero(letters)
    if not any_letter:
        return None
    cells = np.flatnonzero(counts != 0)
    return cells, counts[cells]


def _length_class(grams: int) -> int:
    """Logarithm of a text's n-grams in whole steps of two, at most 12."""
    return min((int(grams) + 1).bit_length() - 1, 12)


#: Length classes that rejection limits are learned for, and the code points that a text is cut to.
SIZES = np.arange(3, 13)
CUTS = (1 << SIZES) // 3 + 1


def prefix_counts(text: str, upto: int = len(SIZES)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(size, cell, count)`` of the n-grams of a text's first code points, as many as each of the first ``upto`` of ``CUTS``.

    A text is hashed once. The n-grams of a cut are those that end within it and two more, of
    its last letters and the blank that the cut puts after them. A size is left out
    if the cut has fewer n-grams than the class below it.
    """
    text = text[: CUTS[upto - 1]]
    if "\u0130" in text or "\u03a3" in text:  # their small letters depend on what follows, or are two
        found = [(i, ngram_counts(text[:cut])) for i, cut in enumerate(CUTS[:upto])]
        found = [(i, c) for i, c in found if c is not None and _length_class(c[1].sum()) >= SIZES[i] - 1]
        none = [np.zeros(0, dtype=np.int64)]
        return tuple(np.concatenate(none + part) for part in ([np.full(len(c[0]), i) for i, c in found], [c[0] for _, c in found], [c[1] for _, c in found]))
    letters = _codes(text)
    keep = _kept(letters)
    ends = np.cumsum(keep)[np.minimum(CUTS[:upto], len(letters) - 1)]
    letters = letters[keep]
    one, two, three = _grams(letters)
    ending = np.full((len(letters), 3), CELLS, dtype=np.uint32)  # CELLS stands for no n-gram
    ending[:, 0] = np.where(letters, one >> SHIFT, CELLS)
    ending[1:, 1] = two >> SHIFT
    ending[2:, 2] = three >> SHIFT
    last = ends - 1
    open_end = letters[last] != 0
    total = np.cumsum(np.count_nonzero(ending != CELLS, axis=1))[last] + 2 * open_end
    at = [i for i in range(upto) if last[i] and _length_class(total[i]) >= SIZES[i] - 1]
    ending, width = ending.ravel(), 2 * CELLS
    keys = [ending[: 3 * ends[i]] + np.uint32(i * width) for i in at]
    tail = [i for i in at if open_end[i]]
    end = last[tail]
    for cut in (one[end] * np.uint32(MULTIPLIERS[2]), two[end - 1] * np.uint32(MULTIPLIERS[1])):
        keys.append((cut >> SHIFT) + np.array(tail, dtype=np.uint32) * np.uint32(width))
    key = np.concatenate(keys)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    counts, key = np.diff(np.append(first, len(key))), key[first]
    real = key & CELLS == 0
    key = key[real].astype(np.int64)
    return key // width, key % width, counts[real]


def class_counts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``prefix_counts`` and, where no cut among them holds all of the text, the whole text in its own class, in place of a cut of that class."""
    size, cells, counts = prefix_counts(text, len(SIZES) - (len(text) > CUTS[-1]))
    if len(size) and CUTS[size[-1]] >= len(text):
        return size, cells, counts
    whole = ngram_counts(text)
    if whole is None or _length_class(whole[1].sum()) < SIZES[0]:
        return size, cells, counts
    own = _length_class(whole[1].sum()) - SIZES[0]
    start, end = np.searchsorted(size, [own, own + 1])
    parts = [(size[:start], cells[:start], counts[:start]), (np.full(len(whole[0]), own), *whole), (size[end:], cells[end:], counts[end:])]
    return tuple(np.concatenate(part) for part in zip(*parts, strict=True))


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    languages: list[str]
    of: np.ndarray
    centroids: np.ndarray
    least: np.ndarray


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


class _Sums:
    """Exact sums of vectors per language and number of a centroid, in one task."""

    def __init__(self):
        self.of: dict[tuple[str, int], np.ndarray] = {}

    def add(self, lang: str, part: int, cells: np.ndarray, vector: np.ndarray) -> None:
        if (lang, part) not in self.of:
            self.of[lang, part] = np.zeros(CELLS, dtype=np.int64)
        self.of[lang, part][cells] += np.rint(vector * UNIT).astype(np.int64)

    def tables(self) -> Iterator[pd.DataFrame]:
        for (lang, part), total in self.of.items():
            cells = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "part": part, "cell": cells, "n": total[cells]})


SUMS = "lang string, part int, cell int, n long"


def _added(rows: DataFrame, task) -> pd.DataFrame:
    """What the tasks found, added up: at most ``CENTROIDS`` vectors of each language reach the driver."""
    return rows.mapInPandas(task, SUMS).groupBy("lang", "part", "cell").agg(F.sum("n").alias("n")).toPandas()


def _centroids(found: pd.DataFrame, idf: np.ndarray | float) -> dict[str, np.ndarray]:
    out = {}
    for lang, own in found.groupby("lang"):
        parts = sorted(own["part"].unique())
        sums = np.zeros((len(parts), CELLS))
        sums[np.searchsorted(parts, own["part"]), own["cell"]] = own["n"]
        out[lang] = _unit(sums * idf).astype(np.float32)
    return out


def _least(rows: DataFrame, idf: np.ndarray, centroids: dict[str, np.ndarray]) -> np.ndarray:
    """Per length class the least 1st percentile, over the languages, of the cosines of all training rows, whole in their own class and cut to the shorter ones."""

    by_cell = {lang: np.ascontiguousarray(c.T) for lang, c in centroids.items()}

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {lang: np.zeros((13, STEPS + 1), dtype=np.int64) for lang in by_cell}
        for batch in batches:
            for lang, text in zip(batch["_lang"], batch["_text"], strict=True):
                if lang not in by_cell:
                    continue
                size, cells, counts = class_counts(text)
                if len(size):
                    v = np.log1p(counts.astype(np.float32)) * idf[cells]
                    near = by_cell[lang][cells]
                    first = np.flatnonzero(np.append(True, size[1:] != size[:-1])).tolist()
                    for i, j in zip(first, [*first[1:], len(size)], strict=True):
                        cosine = float((v[i:j] @ near[i:j]).max()) / float(v[i:j] @ v[i:j]) ** 0.5
                        seen[lang][SIZES[size[i]], int(min(max(cosine, 0.0), 1.0) * STEPS)] += 1
        for lang, counted in seen.items():
            sizes, steps = np.nonzero(counted)
            yield pd.DataFrame({"lang": lang, "part": sizes, "cell": steps, "n": counted[sizes, steps]})

    limits = rows.mapInPandas(task, SUMS).groupBy("lang", "part").agg(F.sum("n").alias("n"), F.percentile("cell", 0.01, F.col("n")).alias("low")).filter("n >= 20").groupBy("part").agg(F.min("low").alias("low"))
    least = np.zeros(13)
    for row in limits.collect():
        least[row.part] = row.low / STEPS
    return least


def fit(docs: DataFrame) -> Model:
    """Document frequencies, centroids and rejection limits, all over all training rows and their whole texts.

    The centroids of a language start from its rows by length and are moved by spherical
    k-means: each round is a pass in which tasks assign their rows and add them up. It ends
    when no sum changes, after ``ROUNDS`` at the latest. Sums are exact, so they don't
    depend on how rows lie in partitions. A row that is repeated counts as often.

    A limit is learned from the whole texts of its length class and from the first part,
    as long as the class, of every longer row; the last class has no longer rows, so it
    takes whole texts only, as predictions do.
    """
    rows = docs.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("_lang"), text_of().alias("_text"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n, sums = np.zeros(CELLS, dtype=np.int64), 0, _Sums()
        for batch in batches:
            for lang, text in zip(batch["_lang"], batch["_text"], strict=True):
                found = ngram_counts(text)
                if found is not None:
                    cells, counts = found
                    seen[cells] += 1
                    n += 1
                    sums.add(lang, int(np.searchsorted(STARTS, np.log2(counts.sum() + 1), side="right")), cells, _unit(np.log1p(counts.astype(np.float32))))
        yield pd.DataFrame({"lang": None, "part": -1, "cell": np.arange(CELLS + 1), "n": np.append(seen, n)})
        yield from sums.tables()

    found = _added(rows, frequencies)
    cells, found = found[found["part"] < 0], found[found["part"] >= 0]
    df = np.zeros(CELLS + 1)
    df[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    if not len(found):
        return Model(idf, [], np.zeros(0, dtype=int), np.zeros((0, CELLS), dtype=np.float32), np.zeros(13))
    centroids = _centroids(found, idf)
    by_cell = {lang: np.ascontiguousarray(c.T) for lang, c in centroids.items()}

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums()
        for batch in batches:
            for lang, text in zip(batch["_lang"], batch["_text"], strict=True):
                found = ngram_counts(text)
                if found is not None:
                    cells, counts = found
                    vector = _unit(np.log1p(counts.astype(np.float32)) * idf[cells])
                    sums.add(lang, int((vector @ by_cell[lang][cells]).argmax()), cells, vector)
        yield from sums.tables()

    before = None
    for _ in range(ROUNDS):
        found = _added(rows, assigned).sort_values(["lang", "part", "cell"], ignore_index=True)
        if before is not None and found.equals(before):
            break
        before, centroids = found, _centroids(found, 1.0)
        by_cell = {lang: np.ascontiguousarray(c.T) for lang, c in centroids.items()}
    languages = sorted(centroids)
    of = np.repeat(np.arange(len(languages)), [len(centroids[lang]) for lang in languages])
    return Model(idf, languages, of, np.concatenate([centroids[lang] for lang in languages]), _least(rows, idf, centroids) * REJECT_SHARE)


PREDICTION = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])


def predict(texts: pd.Series, model: Model) -> pd.DataFrame:
    """Language, cosine and rejection of each text."""
    langs, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    by_cell = np.ascontiguousarray(model.centroids.T)
    for i, text in enumerate(texts if model.languages else ()):
        found = ngram_counts(text)
        if found is not None:
            cells, counts = found
            cosines = _unit(np.log1p(counts.astype(np.float32)) * model.idf[cells]) @ by_cell[cells]
            best = cosines.argmax()
            langs[i], scores[i] = model.languages[model.of[best]], min(max(float(cosines[best]), 0.0), 1.0)
            rejected[i] = scores[i] < model.least[_length_class(counts.sum())]
    return pd.DataFrame({"lang": langs, "score": scores, "rejected": rejected})


def _predictor(docs: DataFrame):
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @pandas_udf(PREDICTION)
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return predict(texts, model.value)

    return predicted(F.col("text").cast("string"))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    Predictions read the whole text and nothing else. A null text or one without
    a letter is ``und`` with score 0 and rejected; so is every text if no language can
    be learned. ``rejected`` marks texts farther from every centroid than training
    texts of their length; their nearest language is still named. Equal cosines go to
    the first language by code point. Repeated rows get equal predictions.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _predictor(docs).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are near enough to a language, with their own columns."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), _predictor(docs).alias("p"))
    return rows.filter("not p.rejected").select("doc.*")
