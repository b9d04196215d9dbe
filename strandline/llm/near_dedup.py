"""Near duplicates by 64-bit SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from strandline.llm.common import rows_with, small_batches, stored, text_of
from strandline.operators.graph import connected_components

#: Words of a shingle, seed of its hash, and the bits that linked fingerprints may differ in.
SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Hashes whose bits are counted at once, so that a long text needs little memory.
CHUNK = 1 << 16


def simhash(text: str | None, words: int = SHINGLE) -> int:
    """Fingerprint of a text as a signed 64-bit integer; texts without words have 0.

    Bytes are lower-cased and split as ASCII only: A-Z and the white space of the
    contract. A text of fewer words is one shingle.
    """
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(parts) - words + 1)
    spans = zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist(), strict=True)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n)
    for i in range(0, n, CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


@pandas_udf(LongType())
def _simhash(texts: pd.Series) -> pd.Series:
    return texts.map(simhash).astype("int64")


def _segments(fp: Column) -> Column:
    """The two halves of a fingerprint with their numbers."""
    return F.array(F.struct(F.lit(0).alias("_seg"), F.shiftrightunsigned(fp, 32).alias("_half")), F.struct(F.lit(1).alias("_seg"), fp.bitwiseAND(F.lit(0xFFFFFFFF)).alias("_half")))


def linked_fingerprints(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints ``_fp`` that differ in at most ``distance`` (3) bits.

    Of two halves of 32 bits, one differs in a single bit at most. Each half looks
    up itself and its neighbours at one bit, flipped from 0 to 1 only, for the
    other fingerprint of the pair makes the way back. Whole distances decide.
    The join asks for a sort-merge: a file of fingerprints says nothing about the
    look-ups they are expanded to, about 34 each, which Spark would broadcast.
    """
    if not 0 <= distance <= 3:
        raise ValueError("halves with balls of one bit find distances up to 3")
    table = prints.select(F.col("_fp").alias("b"), F.inline(_segments(F.col("_fp"))))
    flips = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(32)]), lambda bit: F.col("_half").bitwiseAND(bit) == 0)
    ball = F.concat(F.array(F.lit(0).cast("long")), flips)
    probes = table.select(F.col("b").alias("a"), "_seg", "_half", F.explode(ball).alias("_bit"))
    probes = probes.select("a", "_seg", F.col("_half").bitwiseOR(F.col("_bit")).alias("_half"), (F.col("_bit") == 0).alias("_same"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return probes.join(table.hint("merge"), ["_seg", "_half"]).filter(near & (~F.col("_same") | (F.col("a") < F.col("b")))).select("a", "b")


def _labelled(rows: DataFrame) -> DataFrame:
    """Distinct ``_fp`` of ``rows`` with the label of its component."""
    prints = stored(rows.select("_fp").distinct(), "fingerprints")
    found = connected_components(linked_fingerprints(prints), "a", "b")
    found = found.select(F.col("vertex").alias("_fp"), F.col("component").alias("_label"))
    return prints.join(found, "_fp", "left").select("_fp", F.coalesce("_label", "_fp").alias("_label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    Reads doc_id and text only. Null texts count as empty; texts without words
    share the fingerprint zero and link like any other. Repeated rows are
    independent rows. The component takes the smallest id that is not null, or
    null if it has none. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = stored(docs.select(F.col("doc_id"), _simhash(text_of()).alias("_fp")), "simhash")
    labels = stored(_labelled(rows), "simhash-labels")
    firsts = rows.groupBy("_fp").agg(F.min("doc_id").alias("_first")).join(labels, "_fp")
    smallest = firsts.groupBy("_label").agg(F.min("_first").alias("component_id"))
    of_print = firsts.select("_fp", "_label").join(smallest, "_label").select("_fp", "component_id")
    return rows.join(of_print, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of every component the row with the smallest doc_id (null ids last), with the columns of ``docs``."""
    small_batches(docs.sparkSession)
    keys = {"_k_doc": F.col("doc_id"), "_k_sum": F.xxhash64(text_of())}
    rows = stored(docs.select(*[v.alias(k) for k, v in keys.items()], _simhash(text_of()).alias("_fp")), "simhash")
    firsts = rows.groupBy("_fp").agg(F.min(F.struct(F.col("_k_doc").isNull().alias("_none"), "_k_doc", "_k_sum")).alias("_first"))
    kept = firsts.join(_labelled(rows), "_fp").groupBy("_label").agg(F.min("_first").alias("_first")).select("_first._k_doc", "_first._k_sum")
    return rows_with(docs, keys, kept).filter("row = 1").select("doc.*")
