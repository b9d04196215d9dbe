"""Merging, expanding and sorting of genomic ranges.

Merging runs on two levels. First ranges are merged inside fixed tiles of a
chromosome, so a hot chromosome is spread over many tasks; the few ranges left
are then merged per chromosome. Every carried value has an associative combine
(min, max or sum), so both levels use the same rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.chroms import genomic_rank, strand_rank
from strandline.operators.intervals import interval_join

TILE = 1 << 20
_COMBINE = {"min": F.min, "max": F.max, "sum": F.sum}


def _merge_level(df, parts, keys, start, end, slack, carry):
    w = Window.partitionBy(*parts).orderBy(start, end)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    fresh = reach.isNull() | (F.col(start) > reach + slack)
    marked = df.withColumn("_new", fresh.cast("int"))
    marked = marked.withColumn("_isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*parts, "_isl").agg(
        F.min(start).alias(start), F.max(end).alias(end), *[_COMBINE[how](c).alias(c) for c, how in carry.items()]
    ).select(*keys, start, end, *carry)


def merge_ranges(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_pos",
    end: str = "end_pos",
    slack: int = 0,
    carry: dict[str, str] | None = None,
    tile: int = TILE,
) -> DataFrame:
    """Ranges closer than or equal to ``slack`` become one, per ``keys``."""
    carry = carry or {}
    keys = list(keys)
    rows = df.select(*keys, start, end, *carry)
    # equal ranges first: combines map-side and removes duplicates before any sort
    rows = rows.groupBy(*keys, start, end).agg(*[_COMBINE[h](c).alias(c) for c, h in carry.items()]) if carry else rows.distinct()
    tiled = [*keys, "_tile"]
    rows = rows.withColumn("_tile", F.floor(F.col(start) / tile))
    local = _merge_level(rows, tiled, tiled, start, end, slack, carry)
    # what reaches into a tile from all tiles before it, by one row per tile
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    reach = local.groupBy(*tiled).agg(F.max(end).alias("_z")).withColumn("_reach", F.max("_z").over(before)).drop("_z")
    marked = local.join(reach, tiled).withColumn("_new", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + slack)).cast("int"))
    # islands of a tile don't touch each other: they are numbered inside it, from what the tiles before it opened
    opened = marked.groupBy(*tiled).agg(F.sum("_new").alias("_n")).withColumn("_opened", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*tiled).orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.join(opened, tiled).withColumn("_isl", F.col("_opened") + F.sum("_new").over(inside))
    return numbered.groupBy(*keys, "_isl").agg(F.min(start).alias(start), F.max(end).alias(end), *[_COMBINE[how](c).alias(c) for c, how in carry.items()]).drop("_isl")


def merge_overlapping(regions: DataFrame) -> DataFrame:
    """Touching regions per chromosome and strand become one.

    Names are joined with a comma in region order unless a name is already part
    of the joined text, so only the first occurrence of each name matters.
    """
    keys = ["chrom", "strand"]
    merged = merge_ranges(regions, keys)
    islands = merged.withColumnsRenamed({"start_pos": "m_start", "end_pos": "m_end"})
    firsts = (
        interval_join(regions, islands, on=keys, left_span=("start_pos", "end_pos"), right_span=("m_start", "m_end"), closed=True)
        .groupBy(*keys, "m_start", "m_end", "name")
        .agg(F.min(F.struct("start_pos", "end_pos")).alias("at"))
    )
    names = firsts.groupBy(*keys, "m_start", "m_end").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("named"))
    joined = F.aggregate(
        F.expr("slice(named, 2, size(named))"),
        F.expr("named[0].name"),
        lambda acc, x: F.when(F.contains(acc, x["name"]), acc).otherwise(F.concat(acc, F.lit(","), x["name"])),
    )
    return names.select(
        "chrom", F.col("m_start").alias("start_pos"), F.col("m_end").alias("end_pos"), joined.alias("name"), F.lit("0").alias("score"), "strand"
    )


def merge_nearby(events: DataFrame, keys: Sequence[str] = ("chrom", "event_type"), distance: int = 5000) -> DataFrame:
    """Events with a gap of at most ``distance``; the highest counts and means stay."""
    carry = {c: "max" for c in ("read_count", "avg_mapq", "avg_span") if c in events.columns}
    return merge_ranges(events, keys, slack=distance, carry=carry)


def collapse_ranges(reads: DataFrame, distance: int = 10_000) -> DataFrame:
    """Unique partner spans per read, then merged per chromosome; other fields from the first row."""
    key = ["start2", "end2", "read_id"]
    rest = ["chrom", "start_pos", "end_pos", "gene"]
    unique = reads.groupBy(*key).agg(F.min(F.struct(*rest, "chrom2")).alias("r")).select(*key, "r.*")
    packed = unique.withColumn("first_row", F.struct("start_pos", "end_pos", "gene", "chrom2", *key))
    out = merge_ranges(packed, ["chrom"], slack=distance, carry={"first_row": "min"})
    return out.select("chrom", "start_pos", "end_pos", *[F.col(f"first_row.{c}").alias(c) for c in ("gene", "chrom2", *key)])


def expand_breakpoints(regions: DataFrame, pad: int = 10_000) -> DataFrame:
    """Both ends of a region as padded ranges on both strands (four rows each)."""
    def end(column, strand):
        p = F.col(column)
        return F.struct(F.greatest(F.lit(0), p - pad).alias("start_pos"), (p + pad).alias("end_pos"), F.lit(strand).alias("strand"))

    ends = F.array(*[end(c, s) for c in ("start_pos", "end_pos") for s in ("+", "-")])
    keep = [c for c in regions.columns if c not in ("start_pos", "end_pos", "strand")]
    return regions.withColumn("_e", F.explode(ends)).select(*keep, "_e.*")


def both_strands(regions: DataFrame) -> DataFrame:
    """Rows without a strand are doubled to + and -; all others are kept."""
    strands = F.when(F.col("strand") == ".", F.array(F.lit("+"), F.lit("-"))).otherwise(F.array("strand"))
    return regions.withColumn("strand", F.explode(strands))


def genomic_sort(regions: DataFrame, other: int = 300) -> DataFrame:
    return regions.orderBy(genomic_rank(F.col("chrom"), other), "chrom", strand_rank(F.col("strand")), "start_pos", "end_pos")


def genome_fraction(regions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Covered bases per strand, clipped to the chromosome, over the genome size."""
    lens = lengths.select("chrom", F.col("length").alias("_len"))
    covered = F.greatest(F.lit(0), F.least("end_pos", "_len") - F.greatest(F.col("start_pos"), F.lit(0)))
    parts = regions.join(lens, "chrom").select("strand", covered.alias("bases"))
    parts = parts.unionByName(lengths.select(F.lit("genome").alias("strand"), F.col("length").alias("bases")))

    def total(strand):
        return F.coalesce(F.sum(F.when(F.col("strand") == strand, F.col("bases"))), F.lit(0))

    names = (("genome_size", "genome"), ("plus", "+"), ("minus", "-"), ("unstranded", "."))
    g = F.col("genome_size")
    return parts.agg(*[total(s).alias(n) for n, s in names]).select(
        "genome_size", "plus", "minus", "unstranded",
        (F.col("plus") / g).alias("plus_proportion"),
        (F.col("minus") / g).alias("minus_proportion"),
        (F.col("unstranded") / g).alias("unstranded_proportion"),
        ((F.col("plus") + F.col("minus") + F.col("unstranded")) / (2 * g)).alias("total_proportion"),
    )


def master_regions(sources: dict[str, DataFrame], panel: DataFrame | None = None, expand: Sequence[str] = ("cnv",)) -> DataFrame:
    """Union of all sources on both strands, merged, then merged with the panel."""
    cols = ["chrom", "start_pos", "end_pos", "name", "strand"]
    parts = stranded_sources(sources, expand)
    union = None
    for part in parts.values():
        union = part.select(*cols) if union is None else union.unionByName(part.select(*cols))
    merged = merge_overlapping(union)
    if panel is not None:
        merged = merge_overlapping(merged.select(*cols).unionByName(both_strands(panel).select(*cols)))
    return merged


def stranded_sources(sources: dict[str, DataFrame], expand: Sequence[str] = ("cnv",)) -> dict[str, DataFrame]:
    """Each source as it enters the union: breakpoints widened, rows without strand on both."""
    return {name: expand_breakpoints(df) if name in expand else both_strands(df) for name, df in sources.items()}


def source_report(sources: dict[str, DataFrame], panel: DataFrame, lengths: DataFrame, expand: Sequence[str] = ("cnv",)) -> DataFrame:
    """Regions and covered share of the genome per source, for the panel, and for the merged whole."""
    keys = ["chrom", "strand"]
    parts = {**stranded_sources(sources, expand), "target_panel": both_strands(panel)}
    spans = {name: part.select(*keys, "start_pos", "end_pos") for name, part in parts.items()}
    merged = {name: merge_ranges(rows, keys) for name, rows in spans.items()}
    whole = None
    for rows in merged.values():
        whole = rows if whole is None else whole.unionByName(rows)
    merged["master"] = spans["master"] = merge_ranges(whole, keys)
    out = None
    for name, rows in spans.items():
        counted = rows.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("regions"))
        share = genome_fraction(merged[name], lengths).select("plus_proportion", "minus_proportion", "total_proportion")
        one = counted.join(share, F.lit(True))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def first_per_gene(regions: DataFrame, order: Sequence[str]) -> DataFrame:
    """Comma lists of genes split; the first region of each gene stays."""
    rows = regions.withColumn("gene", F.explode(F.split("name", ","))).withColumn("gene", F.trim("gene")).filter("gene <> ''")
    fields = [*order, *[c for c in ("chrom", "start_pos", "end_pos") if c not in order]]
    return rows.groupBy("gene").agg(F.min(F.struct(*fields)).alias("r")).select("r.*", "gene")
