"""Genome and target coverage, their history and outlier statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.chroms import is_standard, natural_rank
from strandline.functions.quantiles import exact_quantiles
from strandline.operators.intervals import interval_join, overlap_length

TILE = 1 << 20


def genome_coverage(alignments: DataFrame, lengths: DataFrame, tile: int = TILE) -> DataFrame:
    """Reads, covered bases and mean depth per chromosome by a +1/-1 sweep.

    Edges at one position are summed before any sort, and the running depth is
    kept per tile with the depth and the next edge carried between tiles, so a
    hot chromosome does not end in one task.
    """
    keys = ["sample_id", "chrom"]
    rows = alignments.filter("NOT is_unmapped AND NOT is_secondary").select(*keys, "ref_start", "ref_end")
    edge = F.explode(F.array(
        F.struct(F.col("ref_start").alias("pos"), F.lit(1).cast("bigint").alias("d"), F.lit(1).cast("bigint").alias("reads")),
        F.struct(F.col("ref_end").alias("pos"), F.lit(-1).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("reads")),
    ))
    edges = rows.select(*keys, edge.alias("e")).groupBy(*keys, "e.pos").agg(F.sum("e.d").alias("d"), F.sum("e.reads").alias("reads"))
    edges = edges.withColumn("_t", F.floor(F.col("pos") / tile))
    over = Window.partitionBy(*keys).orderBy("_t")
    tiles = (
        edges.groupBy(*keys, "_t")
        .agg(F.sum("d").alias("_d"), F.min("pos").alias("_first"))
        .withColumn("_carry", F.coalesce(F.sum("_d").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_next", F.lead("_first").over(over))
        .select(*keys, "_t", "_carry", "_next")
    )
    inside = Window.partitionBy(*keys, "_t").orderBy("pos")
    swept = (
        edges.join(tiles, [*keys, "_t"])
        .withColumn("depth", F.col("_carry") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("width", F.coalesce(F.lead("pos").over(inside), F.col("_next"), F.col("pos")) - F.col("pos"))
    )
    out = swept.groupBy(*keys).agg(
        F.sum("reads").alias("numreads"),
        F.sum(F.when(F.col("depth") > 0, F.col("width")).otherwise(0)).alias("covbases"),
        F.sum(F.col("depth") * F.col("width")).alias("bases"),
    )
    return out.join(lengths.select("chrom", "length"), "chrom").select(
        *keys, F.lit(1).cast("bigint").alias("start_pos"), F.col("length").alias("end_pos"), "numreads", "covbases", (F.col("bases") / F.col("length")).alias("meandepth")
    )


def target_coverage(alignments: DataFrame, targets: DataFrame, samples: Sequence[str] = ()) -> DataFrame:
    """Clipped overlap bases per target; ``length = end - start + 1``.

    With ``samples`` targets without any read appear with zero bases.
    """
    key = ["sample_id", "chrom", "start_pos", "end_pos", "name"]
    rows = alignments.filter("NOT is_unmapped AND NOT is_secondary").select("sample_id", "chrom", "ref_start", "ref_end")
    hit = interval_join(rows, targets.select("chrom", "start_pos", "end_pos", "name")).withColumn("bases", overlap_length())
    parts = hit.select(*key, "bases")
    if samples:
        zero = targets.withColumn("sample_id", F.explode(F.array(*[F.lit(s) for s in samples])))
        parts = parts.unionByName(zero.select(*key, F.lit(0).cast("bigint").alias("bases")))
    length = F.col("end_pos") - F.col("start_pos") + 1
    return parts.groupBy(*key).agg(F.sum("bases").alias("bases")).select(*key, length.alias("length"), (F.col("bases") / length).alias("coverage"), "bases")


def coverage_merge(parts: Sequence[DataFrame], keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Coverage of several batches added up per region; no region is lost."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


TARGET = ["sample_id", "chrom", "start_pos", "end_pos", "name"]


def cumulative_reads(coverage: DataFrame, batch: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Reads of this batch (0 where missing) added to the earlier totals, per target."""
    new = batch.select(*TARGET, F.col("reads").alias("_new"))
    out = coverage.join(new, TARGET, "left")
    reads = F.coalesce("_new", F.lit(0))
    if previous is not None:
        out = out.join(previous.select(*TARGET, F.col("reads").alias("_old")), TARGET, "left")
        reads = reads + F.coalesce("_old", F.lit(0))
    out = out.withColumn("reads", reads).drop("_new", "_old")
    return out.withColumn("reads_per_length", F.col("reads") / F.col("length"))


def coverage_over_time(batches: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Cumulative bases, reads and coverage per target and batch time."""
    per_batch = batches.groupBy(*keys, "ts").agg(F.sum("bases").alias("bases"), F.sum("reads").alias("reads"))
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = per_batch.withColumns({"bases": F.sum("bases").over(w), "reads": F.sum("reads").over(w)})
    length = F.col("end_pos") - F.col("start_pos") + 1
    return out.withColumns({"length": length, "coverage": F.col("bases") / length, "reads_per_length": F.col("reads") / length})


def quality_level(value, levels=((30, "Excellent"), (20, "Good"), (10, "Moderate")), other="Insufficient"):
    out = None
    for bound, name in levels:
        out = F.when(value >= bound, name) if out is None else out.when(value >= bound, name)
    return out.otherwise(other)


def coverage_summary(genome: DataFrame, targets: DataFrame) -> DataFrame:
    """Global and target depth per sample, their ratio and a quality word."""
    g = genome.groupBy("sample_id").agg((F.sum("covbases") / F.sum("end_pos")).alias("global_coverage"))
    t = targets.groupBy("sample_id").agg((F.sum("bases") / F.sum("length")).alias("target_coverage"))
    out = g.join(t, "sample_id")
    return out.withColumn("enrichment", F.when(F.col("global_coverage") > 0, F.col("target_coverage") / F.col("global_coverage")).otherwise(0.0)).withColumn(
        "quality", quality_level(F.col("target_coverage"))
    )


def coverage_distribution(targets: DataFrame, key: str = "sample_id") -> DataFrame:
    """Median, mean, range and share of targets at 30, 20 and 10 fold."""
    c = F.col("coverage")
    basic = targets.groupBy(key).agg(
        F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"),
        *[(100.0 * F.avg(F.when(c >= n, 1.0).otherwise(0.0))).alias(f"pct_{n}x") for n in (30, 20, 10)],
    )
    return basic.join(exact_quantiles(targets, [key], "coverage", [0.5], ["median"]), key)


def on_off_target_depth(genome: DataFrame, targets: DataFrame) -> DataFrame:
    """Target depth against mean genome depth per standard chromosome; missing is 0."""
    off = genome.filter(is_standard(F.col("chrom"))).groupBy("sample_id", "chrom").agg(F.avg("meandepth").alias("off_target"))
    on = targets.groupBy("sample_id", "chrom").agg((F.sum("bases") / F.sum("length")).alias("on_target"))
    out = off.join(on, ["sample_id", "chrom"], "left")
    return out.select("sample_id", "chrom", natural_rank(F.col("chrom")).alias("chrom_rank"), "off_target", F.coalesce("on_target", F.lit(0.0)).alias("on_target"))


def target_significance(targets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """High where a target holds more than ``threshold`` of the best one's bases."""
    best = targets.groupBy("sample_id").agg(F.max("bases").alias("max_bases"))
    return targets.join(best, "sample_id").withColumn("significance", F.when(F.col("bases") > threshold * F.col("max_bases"), "high").otherwise("medium"))


def significance_summary(marked: DataFrame) -> DataFrame:
    return marked.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("total_targets"), F.count_if(F.col("significance") == "high").alias("significant_targets"), F.avg("bases").alias("average_score")
    )


def targets_over_threshold(targets: DataFrame, threshold: float = 0.1) -> DataFrame:
    return targets.filter(F.col("coverage") >= threshold)


def population_outliers(rows: DataFrame, group: Sequence[str], value: str = "coverage", sd: float = 2.0) -> DataFrame:
    """Rows outside mean +- ``sd`` sample deviations of their group (three rows at least)."""
    stats = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    v, lo, hi = F.col(value), F.col("_mean") - sd * F.col("_sd"), F.col("_mean") + sd * F.col("_sd")
    usable = (F.col("_n") >= 3) & (F.col("_sd") > 0)
    status = F.when(usable & (v > hi), "high").when(usable & (v < lo), "low").otherwise("")
    return rows.join(stats, list(group)).withColumn("outlier", status).drop("_n", "_mean", "_sd")


def target_label(name="name", chrom="chrom", start="start_pos"):
    return F.format_string("%s (%s %.2f Mb)", F.col(name), F.col(chrom), F.col(start) / 1e6)


def outlier_targets(series: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` targets with the highest peak among those ever an outlier, per sample."""
    marked = population_outliers(series, ["sample_id", "ts"])
    per = marked.groupBy(*TARGET).agg(F.max("coverage").alias("max_coverage"), F.count(F.lit(1)).alias("points"), F.max(F.col("outlier") != "").alias("_hit"))
    w = Window.partitionBy("sample_id").orderBy(F.desc("max_coverage"), "chrom", "start_pos", "name")
    ranked = per.filter("_hit").withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    return ranked.filter("points >= 2").withColumn("label", target_label()).drop("_hit")


def iqr_outliers(targets: DataFrame, group: Sequence[str], k: float = 1.5, min_rows: int = 4, value: str = "coverage") -> DataFrame:
    """Gain or Loss outside the quartiles -+ ``k`` times their distance."""
    q = exact_quantiles(targets, group, value, [0.25, 0.75], ["q1", "q3"])
    n = targets.groupBy(*group).agg(F.count(value).alias("_n"))
    spread = k * (F.col("q3") - F.col("q1"))
    status = F.when(F.col("_n") < min_rows, "").when(F.col(value) > F.col("q3") + spread, "Gain").when(F.col(value) < F.col("q1") - spread, "Loss").otherwise("")
    return targets.join(q.join(n, list(group)), list(group)).withColumn("outlier", status).drop("_n")


def boxplot_stats(targets: DataFrame, group: Sequence[str] = ("sample_id", "chrom")) -> DataFrame:
    q = exact_quantiles(targets, group, "coverage", [0.0, 0.25, 0.5, 0.75, 1.0], ["min", "q1", "median", "q3", "max"])
    return q.withColumn("chrom_rank", natural_rank(F.col("chrom")))
