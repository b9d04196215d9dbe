"""Exact duplicates by deterministic block naming, without comparing or trusting hashes.

A text is cut into blocks of a fixed number of code points. The distinct blocks are
sorted and numbered; neighbouring numbers form pairs, the distinct pairs are numbered
again, and so on until one pair is left. Two texts are equal exactly when they end on
the same level with the same pair, for a number stands for one block sequence only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, drop_stored, rows_with, stored, text_of

#: Code points of a block. Larger blocks mean fewer rows, smaller ones shorter sort keys.
BLOCK = 256
#: Parts that the rows of a group are dealt to when they take their group's result.
PARTS = 64


def normalised(text: Column) -> Column:
    """The text without any white space character."""
    return F.regexp_replace(text, f"{SPACE}+", "")


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys, sorted within partitions, each with its own number from 1."""
    return df.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("_name", F.monotonically_increasing_id() + 1)


def _pairs(named: DataFrame) -> DataFrame:
    """Neighbours 2i and 2i+1 of a row of names in one row; 0 stands for a missing second."""
    even = F.col("_pos") % 2 == 0
    info = [F.max(c).alias(c) for c in ("_doc", "_len", "_sha") if c in named.columns]
    return named.groupBy("_rid", (F.col("_pos") / 2).cast("long").alias("_at")).agg(
        F.max(F.when(even, F.col("_name"))).alias("_a"),
        F.coalesce(F.max(F.when(~even, F.col("_name"))), F.lit(0)).alias("_b"),
        F.max(((F.col("_n") + 1) / 2).cast("long")).alias("_n"),
        *info,
    ).withColumnRenamed("_at", "_pos")


def exact_duplicates(docs: DataFrame, block: int = BLOCK, block_key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Reads ``doc_id`` and ``text`` only, so other columns may have any name. Null
    texts count as empty, and empty texts are equal. Of a group stays the row with
    the most code points, then the smallest doc_id (null ids last), then the first
    one read; rows repeated with the same id are counted one by one and one of
    them stays. An empty table gives an empty result.

    Blocks are numbered from their whole text. ``block_key`` only shortens the
    join that brings numbers to their blocks: where it gives one value to two
    different blocks, the join compares the blocks themselves. These joins are
    sort-merged, for a file of sorted numbers is much smaller than its rows in memory.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").alias("_doc"), text_of().alias("_text"))
    texts = texts.select("_rid", "_doc", F.length("_text").cast("long").alias("_len"), normalised(F.col("_text")).alias("_text"))
    cut = F.when(F.col("_text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block}}}"), 0))
    blocks = texts.select("_rid", "_doc", "_len", F.sha2("_text", 256).alias("_sha"), cut.alias("_blocks"))
    first = lambda c: F.when(F.col("_pos") == 0, F.col(c)).alias(c)
    blocks = blocks.select("_rid", "_doc", "_len", "_sha", F.size("_blocks").cast("long").alias("_n"), F.posexplode("_blocks").alias("_pos", "_block"))
    blocks = blocks.select("_rid", "_pos", "_n", first("_doc"), first("_len"), first("_sha"), "_block", block_key(F.col("_block")).alias("_key"))
    # Texts are cleaned and cut once; names read the blocks, the join reads all but them.
    blocks = stored(blocks, "blocks")

    names = stored(_numbered(blocks, "_block").select(block_key(F.col("_block")).alias("_key"), "_name"), "block-names")
    by = ["_key"]
    if names.groupBy("_key").count().filter("count > 1").limit(1).count():
        drop_stored(names)
        by = ["_key", "_block"]
        names = stored(_numbered(blocks, *by), "block-names")
    level = stored(_pairs(blocks.join(names.hint("merge"), by)), "block-pairs")
    drop_stored(blocks, names)

    levels = [level]
    longest = level.agg(F.max("_n")).first()[0] or 0
    while longest > 1:
        # A text with one pair has its identity; the others go on.
        going = level.filter("_n > 1").select("_rid", "_pos", "_n", "_a", "_b")
        names = stored(_numbered(going, "_a", "_b"), "pair-names")
        level = stored(_pairs(going.join(names.hint("merge"), ["_a", "_b"])), "block-pairs")
        drop_stored(names)
        levels.append(level)
        longest = (longest + 1) // 2

    ends = levels[0].filter("_pos = 0")
    about = ["_rid", "_doc", "_len", "_sha"]
    rows = ends.filter("_n = 1").select(*about, F.lit(0).alias("_level"), "_a", "_b")
    later = None
    for k, table in enumerate(levels[1:], 1):
        done = table.filter("_n = 1").select("_rid", F.lit(k).alias("_level"), "_a", "_b")
        later = done if later is None else later.unionByName(done)
    if later is not None:
        rows = rows.unionByName(ends.filter("_n > 1").select(*about).join(later, "_rid"))
    rows = stored(rows.withColumn("_part", F.pmod(F.xxhash64("_rid"), F.lit(PARTS))), "identities")
    drop_stored(*levels)

    # A group goes to its rows once per part that they are in, so no task meets all rows of a large one.
    best = F.min(F.struct(-F.col("_len"), F.col("_doc").isNull(), F.col("_doc"), F.col("_rid")))
    groups = rows.groupBy("_level", "_a", "_b").agg(best.alias("_best"), F.count(F.lit(1)).alias("_size"), F.collect_set("_part").alias("_parts"))
    groups = groups.select("_level", "_a", "_b", "_best", "_size", F.explode("_parts").alias("_part"))
    return rows.join(groups, ["_level", "_a", "_b", "_part"]).select(
        F.col("_doc").alias("doc_id"), F.col("_best._doc").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_rid") == F.col("_best._rid")).alias("kept"), F.col("_sha").alias("text_sha256"), F.col("_len").alias("n_code_points"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only.

    A row is found again by its id, digest and length; of rows that agree in all
    three (white space in other places at most) one stays.
    """
    keys = {"_k_doc": F.col("doc_id"), "_k_sha": F.sha2(normalised(text_of()), 256), "_k_len": F.length(text_of()).cast("long")}
    kept = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_k_doc"), F.col("text_sha256").alias("_k_sha"), F.col("n_code_points").alias("_k_len")).distinct()
    return rows_with(docs, keys, kept).filter("row = 1").select("doc.*")


SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as s,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents),
g as (select norm, count(*) as group_size, arg_min(doc_id, (-n, doc_id)) as keep_id from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.s as text_sha256, t.n as n_code_points
from t join g using (norm)
"""
