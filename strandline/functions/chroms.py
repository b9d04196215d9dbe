"""Chromosome names: filters, canonical form and sort ranks."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(chrom: Column) -> Column:
    """``1`` and ``chr1`` both become ``chr1``; other names are kept."""
    return F.when(chrom.rlike("^([0-9]+|X|Y|M)$"), F.concat(F.lit("chr"), chrom)).otherwise(chrom)


def bare(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def is_standard(chrom: Column) -> Column:
    return chrom.rlike("^chr([0-9]+|X|Y)$")


def is_autosome(chrom: Column) -> Column:
    return chrom.rlike("^chr[0-9]+$")


def _rank(chrom: Column, x: int, y: int, m: int, other: int) -> Column:
    name = bare(chrom)
    number = F.when(name.rlike("^[0-9]+$"), name.try_cast("int"))
    return (
        F.when(number.between(1, 22), number)
        .when(name == "X", x)
        .when(name == "Y", y)
        .when(name.isin("M", "MT"), m)
        .otherwise(other)
        .cast("bigint")
    )


def genomic_rank(chrom: Column, other: int = 200) -> Column:
    """Order of region files: 1..22, then X, Y, M, everything else last."""
    return _rank(chrom, 100, 101, 102, other)


def natural_rank(chrom: Column) -> Column:
    """Order of charts and tables: 1..22, X, Y, M, everything else last."""
    return _rank(chrom, 23, 24, 25, 1000)


def strand_rank(strand: Column) -> Column:
    return F.when(strand == "+", 0).when(strand == "-", 1).otherwise(2).cast("bigint")
