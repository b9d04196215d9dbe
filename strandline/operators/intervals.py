"""Interval joins.

Spark has no range join, so every overlap join is an equi-join on
``(keys, bucket)``: both sides are expanded to the fixed-width buckets they
touch and a pair is kept only in its first shared bucket, so no ``distinct`` is
needed afterwards. The join asks for a sort-merge, in which AQE splits hot buckets:
a file's size says little about the rows that it holds once they are expanded, so a
panel is broadcast only where the caller marks it with ``broadcast``. Spans that may be
as long as a chromosome meet in nested bins instead, one stored row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 16_384


def _bucket(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def _with_buckets(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per touched bucket; most rows touch one, so that case is cheap."""
    return df.withColumn("_b", F.explode(F.when(last <= first, F.array(first)).otherwise(F.sequence(first, last))))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] = ("chrom",),
    left_span: tuple[str, str] = ("ref_start", "ref_end"),
    right_span: tuple[str, str] = ("start_pos", "end_pos"),
    min_overlap: int = 0,
    closed: bool = False,
    width: int = BUCKET,
    condition: Column | None = None,
) -> DataFrame:
    """All pairs whose overlap is greater than ``min_overlap`` bases.

    Spans are half-open; with ``closed`` both ends belong to the interval.
    Apart from ``on`` the two sides must have different column names.
    """
    extra = 1 if closed else 0
    ls, le = F.col(left_span[0]), F.col(left_span[1]) + extra
    rs, re_ = F.col(right_span[0]), F.col(right_span[1]) + extra
    lefts = _with_buckets(left, _bucket(ls, width), _bucket(le - 1, width)).alias("l")
    rights = right
    for key in on:
        rights = rights.withColumnRenamed(key, f"_r_{key}")
    rights = _with_buckets(rights, _bucket(rs, width), _bucket(re_ - 1, width)).withColumnRenamed("_b", "_rb")
    keep = F.col("_b") == F.col("_rb")
    for key in on:
        keep = keep & (F.col(key) == F.col(f"_r_{key}"))
    keep = keep & (F.least(le, re_) - F.greatest(ls, rs) > min_overlap)
    keep = keep & (F.col("_b") == F.greatest(_bucket(ls, width), _bucket(rs, width)))
    if condition is not None:
        keep = keep & condition
    return lefts.join(rights.hint("merge"), keep, "inner").drop("_b", "_rb", *[f"_r_{k}" for k in on])


#: Bins of the nested join are BUCKET * 8^k wide; the widest holds any chromosome.
LEVELS = 6


def _own_bin(first: Column, last: Column) -> Column:
    """Level and number of the narrowest bin that holds positions ``first`` to ``last``."""
    fits = None
    for k in range(LEVELS):
        width = BUCKET * 8**k
        here = F.struct(F.lit(k).alias("level"), _bucket(first, width).alias("bin"))
        found = _bucket(first, width) == _bucket(last, width)
        fits = F.when(found, here) if fits is None else fits.when(found, here)
    return fits.otherwise(F.struct(F.lit(LEVELS).alias("level"), F.lit(0).cast("bigint").alias("bin")))


def _wider_bins(own: Column) -> Column:
    """The bins around a bin, one per wider level."""
    levels = F.sequence(own["level"] + 1, F.lit(LEVELS))
    number = lambda k: F.when(k == LEVELS, F.lit(0).cast("bigint")).otherwise(F.floor(own["bin"] / F.pow(F.lit(8.0), k - own["level"])).cast("bigint"))
    return F.when(own["level"] == LEVELS, F.array().cast("array<struct<level:int,bin:bigint>>")).otherwise(F.transform(levels, lambda k: F.struct(k.alias("level"), number(k).alias("bin"))))


def nested_interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] = ("chrom",),
    left_span: tuple[str, str] = ("ref_start", "ref_end"),
    right_span: tuple[str, str] = ("start_pos", "end_pos"),
    min_overlap: int = 0,
    closed: bool = False,
) -> DataFrame:
    """The pairs of ``interval_join`` for spans of any length: no span is copied per bucket that it touches.

    Bins are nested, eight in the next wider one. A span is stored once, in the
    narrowest bin that holds it, and looked up in that bin and those around it, so a
    whole chromosome is one stored row and at most six look-ups. Spans that overlap lie
    in bins of which one holds the other, so two joins find each pair once: stored left
    spans with right look-ups, and left look-ups in wider bins with stored right spans.
    Both are sort-merged, unless the caller marks ``left`` with ``broadcast``.
    """
    extra = 1 if closed else 0
    ls, le = F.col(left_span[0]), F.col(left_span[1]) + extra
    rs, re_ = F.col(right_span[0]), F.col(right_span[1]) + extra
    rights = right.withColumnsRenamed({k: f"_r_{k}" for k in on}).withColumn("_own", _own_bin(rs, re_ - 1)).filter(rs < re_)
    lefts = left.withColumn("_own", _own_bin(ls, le - 1)).filter(ls < le)
    lefts, rights = lefts.withColumnRenamed("_own", "_lo"), rights.withColumnRenamed("_own", "_ro")
    own_l, own_r = F.col("_lo"), F.col("_ro")
    met = F.least(le, re_) - F.greatest(ls, rs) > min_overlap
    for key in on:
        met = met & (F.col(key) == F.col(f"_r_{key}"))
    narrow = lefts.join(rights.withColumn("_rb", F.explode(F.concat(F.array(own_r), _wider_bins(own_r)))).hint("merge"), (own_l == F.col("_rb")) & met).drop("_rb")
    wide = lefts.withColumn("_lb", F.explode(_wider_bins(own_l))).join(rights.hint("merge"), (F.col("_lb") == own_r) & met).drop("_lb")
    return narrow.unionByName(wide).drop("_lo", "_ro", *[f"_r_{k}" for k in on])


def overlap_length(left_span=("ref_start", "ref_end"), right_span=("start_pos", "end_pos")) -> Column:
    return F.least(F.col(left_span[1]), F.col(right_span[1])) - F.greatest(F.col(left_span[0]), F.col(right_span[0]))


def tagged_overlap(alignments: DataFrame, target: DataFrame, genome: DataFrame, min_overlap: int = 99) -> DataFrame:
    """Both panels in one pass; ``region_type`` tells where a pair comes from."""
    panels = target.withColumn("region_type", F.lit("target")).unionByName(genome.withColumn("region_type", F.lit("genome")))
    return interval_join(alignments, panels, min_overlap=min_overlap)


def primary_only(alignments: DataFrame) -> DataFrame:
    return alignments.filter(~F.col("is_secondary") & ~F.col("is_supplementary") & ~F.col("is_unmapped"))


def reads_on_regions(alignments: DataFrame, regions: DataFrame, min_qs: float | None = 12.0) -> DataFrame:
    """Distinct reads with a primary alignment touching any region."""
    rows = primary_only(alignments)
    if min_qs is not None:
        rows = rows.filter(F.col("qs").isNull() | (F.col("qs") >= min_qs))
    rows = rows.select("sample_id", "read_id", "chrom", "ref_start", "ref_end")
    return interval_join(rows, regions.select("chrom", "start_pos", "end_pos")).select("sample_id", "read_id").distinct()


def extract_target_reads(alignments: DataFrame, regions: DataFrame) -> DataFrame:
    """Every alignment of the reads whose primary touches a region."""
    names = reads_on_regions(alignments, regions, min_qs=None)
    return alignments.join(names, ["sample_id", "read_id"], "left_semi")


def count_reads_per_target(alignments: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary alignments per target and sample-free total; targets without reads stay with 0."""
    rows = primary_only(alignments).select("chrom", "ref_start", "ref_end")
    hits = interval_join(rows, regions).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return regions.join(hits, list(keys), "left").withColumn("reads", F.coalesce("_n", F.lit(0))).drop("_n")


def first_matching_region(points: DataFrame, regions: DataFrame, point_keys: Sequence[str], order: str, position: str = "pos") -> DataFrame:
    """The first region in ``order`` whose closed interval holds the point, one row per distinct point.

    ``min`` of a struct instead of a ranking window: it combines map-side.
    """
    side = regions.withColumn("_p", F.struct(order, *[c for c in regions.columns if c not in (order, "chrom")]))
    side = side.select("chrom", F.col("start_pos").alias("_rs"), F.col("end_pos").alias("_re"), "_p")
    pairs = interval_join(points.withColumn("_pe", F.col(position)), side, left_span=(position, "_pe"), right_span=("_rs", "_re"), closed=True)
    rest = [c for c in points.columns if c not in point_keys]
    best = pairs.groupBy(*point_keys, *rest).agg(F.min("_p").alias("_p"))
    return best.select(*points.columns, "_p.*")


def genes_in_region(spans: DataFrame, genes: DataFrame, keys: Sequence[str], span=("start_pos", "end_pos"), distinct: bool = True) -> DataFrame:
    """Distinct genes touching each closed region, as a sorted list; without ``distinct`` a name counts once per row of ``genes``."""
    side = genes.select("chrom", F.col("start_pos").alias("_gs"), F.col("end_pos").alias("_ge"), "gene")
    hits = nested_interval_join(spans, side, left_span=span, right_span=("_gs", "_ge"), closed=True)
    named = hits.select(*keys, "gene")
    return (named.distinct() if distinct else named).groupBy(*keys).agg(F.array_sort(F.collect_list("gene")).alias("genes"))


def intersect_target_genes(regions: DataFrame, targets: DataFrame) -> DataFrame:
    """Regions touching any target, kept as they are."""
    ids = regions.columns
    side = targets.select("chrom", F.col("start_pos").alias("_ts"), F.col("end_pos").alias("_te"))
    return interval_join(regions, side, left_span=("start_pos", "end_pos"), right_span=("_ts", "_te")).select(*ids).distinct()


def window_containment(points: DataFrame, windows: DataFrame, position: str = "pos") -> DataFrame:
    """Pairs where ``[pos, pos+1)`` lies inside ``[start_pos, end_pos)``; every window matches."""
    side = points.withColumn("_pe", F.col(position) + 1)
    return interval_join(side, windows, left_span=(position, "_pe")).drop("_pe")
