"""Nearest neighbours by inner product with collision-counting hashing.

Vectors are lengthened by one component so that all of an index have the same norm;
then the nearest by distance are the nearest by inner product. An index projects its
vectors on random directions, orthogonal in sets, and sorts each projection. Around a
query's own projections windows open and widen round by round; a vector met in enough
of the windows is verified on the original components.

Every block of vectors is indexed once, in a file below the shared folder. Tasks hold
one index at a time and stream the queries past it, which lie in files too.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import open_folder, stored
from strandline.session import scratch_path

#: Projections, windows that must agree, and the factor by which windows widen that hold too few vectors.
PROJECTIONS, COLLISIONS, WIDEN = 130, 110, 1.1
#: Windows reach this many times as far as the k-th found is away: a vector there is in 113 of 130 on average.
REACH = 1.5
#: Vectors of one index, queries of one file, files that one task streams past an index, and queries counted at once.
BLOCK, CHUNK, FILES, BATCH = 8_192, 1_024, 8, 256
#: Vectors of an index whose distances say how wide the first windows are.
SAMPLE = 1_024
SEED = 5


def directions(dim: int) -> np.ndarray:
    """Random directions; each run of ``dim`` is orthogonal, which makes counts vary less than free draws."""
    rng, sets = np.random.default_rng([SEED, dim]), []
    for i in range(0, PROJECTIONS, dim):
        sets.append(np.linalg.qr(rng.standard_normal((dim, min(dim, PROJECTIONS - i))))[0].T * np.sqrt(dim))
    return np.concatenate(sets)


def exponent(rows: np.ndarray) -> int:
    """The power of two that brings the largest component to at most 1; scaling by it rounds nothing."""
    return int(np.frexp(np.abs(rows).max(initial=0.0))[1])


class Index:
    """Sorted projections of a block of vectors, each different (id, vector) once with its number of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.copies, self.exponent = ids, copies, exponent(vectors)
        self.vectors = np.ldexp(vectors, -self.exponent)
        squares = (self.vectors**2).sum(axis=1)
        self.norm = float(np.sqrt(squares.max())) * (1 + 1e-12)
        self.directions = directions(vectors.shape[1] + 1)
        places = self.directions[:, :-1] @ self.vectors.T + self.directions[:, -1:] * np.sqrt(np.maximum(self.norm**2 - squares, 0))
        self.order = np.argsort(places, axis=1, kind="stable") if order is None else order.astype(np.int64)
        self.sorted = np.take_along_axis(places, self.order, axis=1)
        self.rough = self.vectors.astype(np.float32)
        self.sample = self.vectors[:: max(1, len(ids) // SAMPLE)]
        #: Vectors compared with a query, to be read as a share of all pairs.
        self.verified = 0

    def write(self, file) -> None:
        vectors = np.ldexp(self.vectors, self.exponent)
        single = vectors.astype(np.float32) if self.exponent < 128 else vectors
        narrow = np.uint16 if len(self.ids) <= 1 << 16 else np.uint32
        np.savez(file, ids=self.ids, copies=self.copies, order=self.order.astype(narrow), vectors=single if (single == vectors).all() else vectors)

    @classmethod
    def read(cls, file) -> Index:
        with np.load(file) as held:
            return cls(held["ids"], held["vectors"].astype(float), held["copies"], held["order"])

    def _edges(self, centres: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and end of each query's window in each sorted projection."""
        lo = [np.searchsorted(s, c - widths, "left") for s, c in zip(self.sorted, centres.T, strict=True)]
        hi = [np.searchsorted(s, c + widths, "right") for s, c in zip(self.sorted, centres.T, strict=True)]
        return np.array(lo).T, np.array(hi).T

    def _met(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of the windows hold each vector; what lies outside is counted, since it is less."""
        n = len(self.ids)
        out = [self.order[i, a:b] for i, (x, y) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)) for a, b in ((0, x), (y, n)) if a < b]
        return PROJECTIONS - (np.bincount(np.concatenate(out), minlength=n) if out else np.zeros(n, dtype=np.int64))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int, float]]:
        """``(query id, id, rows, inner product)`` of the ``k`` nearest found of each query, ties to smaller ids."""
        for i in range(0, len(queries), BATCH):
            yield from self._search(own[i : i + BATCH], queries[i : i + BATCH], k)

    def _search(self, own: np.ndarray, given: np.ndarray, k: int) -> Iterator[tuple[int, int, int, float]]:
        n, exponents = len(self.ids), np.array([exponent(v) for v in given])
        queries = np.ldexp(given, -exponents[:, None])
        norms = np.linalg.norm(queries, axis=1)
        scale = self.norm / norms
        # Distance to a vector of inner product x: vectors and scaled queries all have one norm.
        distance = lambda x, q: np.sqrt(np.maximum(2 * self.norm**2 - 2 * scale[q] * x, 0.0))
        centres = (queries * scale[:, None]) @ self.directions[:, :-1].T
        near = np.sort(queries @ self.sample.T, axis=1)[:, ::-1]
        expected = min(near.shape[1] - 1, int(k * near.shape[1] / n))
        every = np.arange(len(queries))
        # Windows that begin a little narrower than the sample says widen if need be; too wide ones verify too many.
        widths = np.maximum(0.92 * REACH * distance(near[:, expected], every), 1e-9 * self.norm)
        rough = queries.astype(np.float32)
        # What single precision may be off by; the best are measured again in double precision.
        slack = 1e-4 * self.norm * norms
        found = [np.zeros(0, dtype=np.int64) for _ in every]
        scores = [np.zeros(0) for _ in every]
        counts: list[np.ndarray] = []
        before_lo, before_hi = self._edges(centres, widths)
        lo, hi, open_ = before_lo, before_hi, every
        while len(open_):
            still = []
            for r, q in enumerate(open_):
                if len(counts) <= q:
                    counts.append(self._met(lo[r], hi[r]))
                else:
                    more = zip(lo[r].tolist(), before_lo[q].tolist(), before_hi[q].tolist(), hi[r].tolist(), strict=True)
                    new = [self.order[i, a:b] for i, (a, c, d, e) in enumerate(more) for a, b in ((a, c), (d, e)) if a < b]
                    if new:
                        counts[q] += np.bincount(np.concatenate(new), minlength=n)
                    before_lo[q], before_hi[q] = lo[r], hi[r]
                mine = self.ids == own[q]
                others = n - int(mine.sum())
                wanted = min(k, others)
                # Verified vectors are marked by a count that no window reaches.
                fresh = np.flatnonzero((counts[q] >= COLLISIONS) & ~mine)
                counts[q][fresh] = -(1 << 40)
                found[q] = np.concatenate((found[q], fresh))
                scores[q] = np.concatenate((scores[q], self.rough[fresh] @ rough[q]))
                if len(found[q]) == others:
                    continue
                if len(found[q]) < wanted:
                    widths[q] *= WIDEN
                    still.append(q)
                    continue
                farthest = REACH * float(distance(np.partition(scores[q], -wanted)[-wanted] - slack[q], q))
                if widths[q] < farthest:
                    widths[q] = farthest
                    still.append(q)
            open_ = np.array(still, dtype=np.int64)
            if len(open_):
                lo, hi = self._edges(centres[open_], widths[open_])
        for q in every:
            self.verified += len(found[q])
            wanted = min(k, len(found[q]))
            if not wanted:
                continue
            least = np.partition(scores[q], -wanted)[-wanted]
            best = found[q][scores[q] >= least - slack[q]]
            exact = (self.vectors[best] * queries[q]).sum(axis=1)
            with np.errstate(over="ignore"):
                value = np.ldexp(exact, self.exponent + exponents[q])
            for j in np.lexsort((self.ids[best], -exact))[:wanted]:
                yield int(own[q]), int(self.ids[best[j]]), int(self.copies[best[j]]), float(value[j])


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the vectors that can be compared: with an id, no null or non-finite component, not zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(fine & F.exists("v", lambda x: x != 0))


def _octave():
    """Norm of a vector as a power of two, rounded down; of the largest component where squares leave the range of doubles."""
    squares = F.col("squares")
    largest = F.array_max(F.transform("v", F.abs))
    return F.floor(F.when(squares.between(1e-290, 1e300), F.log2(squares) / 2).otherwise(F.log2(largest))).cast("int")


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def _save(folder: str, write) -> str:
    """A file of its own name for every attempt of a task; only those that the stored table names are read."""
    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    name, held = f"{uuid.uuid4().hex}.npz", io.BytesIO()
    write(held)
    with system.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(held.getbuffer())
    return f"{folder.rstrip('/')}/{name}"


def _load(uri: str) -> io.BytesIO:
    system, path = open_folder(uri)
    with system.open_input_file(path) as file:
        return io.BytesIO(file.read())


def build(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Indexes ``vectors`` (vec_id, v) in blocks of about ``block``; gives a stored table (dim, path).

    A block holds vectors of one length and of norms within a factor of two (of largest
    components, where squares leave the range of doubles), so that
    a few long ones widen the windows of their own blocks only. The hash of id and
    vector gives the block, and equal rows are kept once with their number: neither
    a repeated id nor a repeated row fills a block.
    """
    rows = vectors.withColumns({"dim": F.size("v"), "squares": F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)})
    rows = rows.withColumn("octave", _octave()).drop("squares")
    sizes = rows.groupBy("dim", "octave").agg(F.count(F.lit(1)).alias("_rows"))
    place = F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("_rows") / block)).cast("int")
    keys = ["dim", "octave", "block"]
    once = rows.join(sizes, ["dim", "octave"]).withColumn("block", place).groupBy(*keys, "vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    folder = scratch_path(vectors.sparkSession, "vector-index")

    def indexed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id"], kind="stable")
        index = Index(group["vec_id"].to_numpy(), _matrix(group["v"]), group["copies"].to_numpy())
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "path": [_save(folder, index.write)]})

    return stored(once.groupBy(*keys).applyInPandas(indexed, "dim int, path string"), "vector-blocks")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest of each row whose id ``every`` divides, against all rows.

    Reads vec_id and embedding. Vectors without id, empty, zero or with a component
    that is null or not finite take no part; vectors of different lengths don't
    meet. Rows that repeat an id are candidates each, but never of a query of that
    id; a repeated query id is asked once, for its first vector in order. Equal
    scores go to the smaller id; products beyond the range of doubles are infinite
    and equal. Every row is indexed.
    """
    rows = usable(vectors)
    blocks = build(rows, block)
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("dim", F.size("v")).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    asked = stored(asked, "vector-queries")
    folder = scratch_path(vectors.sparkSession, "vector-query-files")

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        ids, v = group["vec_id"].to_numpy(), _matrix(group["v"])
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "chunk": [group["chunk"].iloc[0]], "queries": [_save(folder, lambda f: np.savez(f, ids=ids, v=v))]})

    chunks = -(-max(asked.count(), 1) // chunk)
    files = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).groupBy("dim", "chunk").applyInPandas(packed, "dim int, chunk int, queries string")
    files = stored(files, "vector-query-chunks")

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, index = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if held != r.path:
                    held, index = r.path, Index.read(_load(r.path))
                with np.load(_load(r.queries)) as q:
                    found = list(index.search(q["ids"], q["v"], k))
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "copies", "score"]).astype({"query_id": "int64", "vec_id": "int64", "copies": "int64", "score": "float64"})

    # Rows of file names: each pair of an index and a file of queries is one unit of work.
    pairs = blocks.join(files, "dim").select("path", "chunk", "queries")
    tasks = max(1, blocks.count() * -(-chunks // FILES))
    near = pairs.repartitionByRange(tasks, "path", "chunk").sortWithinPartitions("path", "chunk").mapInPandas(searched, "query_id long, vec_id long, copies long, score double")
    near = near.select("query_id", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.least(F.col("copies"), F.lit(k)).cast("int"))).alias("_copy"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
