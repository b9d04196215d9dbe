"""Expressions over text fields of alignment and variant records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cigar_length(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of the operations named in ``ops``."""
    lengths = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint"))


def reference_length(cigar: Column) -> Column:
    return cigar_length(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    return cigar_length(cigar, "MIS=X")


def supplementary_spans(alignments: DataFrame) -> DataFrame:
    """One row per entry of the SA text.

    The end is the position plus the query length of the entry (100 where the
    text has no operations); a missing quality is 0; chrM entries are dropped.
    """
    entry = F.explode(F.filter(F.split("sa", ";"), lambda x: F.trim(x) != ""))
    rows = alignments.filter(F.col("sa").isNotNull()).withColumn("_e", entry)
    part = F.split("_e", ",")
    cigar = F.try_element_at(part, F.lit(4))
    length = query_length(cigar)
    pos = F.try_element_at(part, F.lit(2)).try_cast("bigint")
    return (
        rows.withColumn("sa_chrom", F.try_element_at(part, F.lit(1)))
        .withColumn("sa_start", pos)
        .withColumn("sa_end", pos + F.when(length > 0, length).otherwise(100))
        .withColumn("sa_strand", F.try_element_at(part, F.lit(3)))
        .withColumn("sa_mapq", F.coalesce(F.try_element_at(part, F.lit(5)).try_cast("int"), F.lit(0)))
        .filter((F.col("sa_chrom") != "chrM") & pos.isNotNull())
        .drop("_e")
    )


def aligned_blocks(alignments: DataFrame) -> DataFrame:
    """Gap-free blocks of an alignment: reference and read coordinates of matches."""
    ops = F.arrays_zip(
        F.transform(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("bigint")).alias("n"),
        F.regexp_extract_all("cigar", F.lit("[0-9]+([MIDNSHP=X])"), F.lit(1)).alias("op"),
    )
    start = F.struct(
        F.col("ref_start").alias("ref"),
        F.lit(0).cast("bigint").alias("read"),
        F.expr("cast(array() as array<struct<ref:bigint,read:bigint,length:bigint>>)").alias("blocks"),
    )

    def step(acc, op):
        match = op["op"].isin("M", "=", "X")
        block = F.struct(acc["ref"].alias("ref"), acc["read"].alias("read"), op["n"].alias("length"))
        return F.struct(
            (acc["ref"] + F.when(match | op["op"].isin("D", "N"), op["n"]).otherwise(0)).alias("ref"),
            (acc["read"] + F.when(match | op["op"].isin("I", "S"), op["n"]).otherwise(0)).alias("read"),
            F.when(match, F.concat(acc["blocks"], F.array(block))).otherwise(acc["blocks"]).alias("blocks"),
        )

    blocks = F.aggregate(F.col("_ops"), start, step, lambda acc: acc["blocks"])
    rows = alignments.withColumn("_ops", ops).withColumn("_block", F.explode(blocks))
    return rows.select(
        *alignments.columns,
        F.col("_block.ref").alias("block_start"),
        (F.col("_block.ref") + F.col("_block.length")).alias("block_end"),
        F.col("_block.read").alias("read_offset"),
    )


def info_map(info: Column) -> Column:
    """Key-value map of an INFO text; bare flags become ``true``."""
    pairs = F.transform(
        F.filter(F.split(info, ";"), lambda x: x != ""),
        lambda x: F.struct(
            F.substring_index(x, "=", 1).alias("k"),
            F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("true").alias("v"),
        ),
    )
    # a repeated key keeps its last value
    return F.map_from_entries(
        F.aggregate(
            pairs,
            F.expr("cast(array() as array<struct<k:string,v:string>>)"),
            lambda acc, x: F.concat(F.filter(acc, lambda y: y["k"] != x["k"]), F.array(x)),
        )
    )
