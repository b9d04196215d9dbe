"""Copy number tracks in long form ``(sample_id, chrom, bin_idx, value)``.

Counting over reads combines map-side; everything after it works on bins, whose
number is bounded by the genome length over the bin width, so windows per
chromosome stay small however many reads there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.chroms import is_autosome
from strandline.operators.intervals import interval_join
from strandline.session import keep

TRACK = ["sample_id", "chrom"]

#: fixed values: gain and loss thresholds per chromosome class and sex
CNV_THRESHOLDS = {
    "autosome": (0.4, -0.4),
    "chrX male": (0.3, -0.3),
    "chrX female": (0.75, -0.75),
    "chrY male": (0.5, -0.5),
    "chrY female": (0.2, -1.0),
}
MAX_BIN_WIDTH = 10_000_000


def cnv_bin_counts(starts: DataFrame, width: int = 1_000_000, ploidy: float = 2.0, min_mapq: int = 60) -> DataFrame:
    """Starts per bin over the mean autosomal count; empty bins are 0."""
    counts = starts.filter((F.col("mapq") >= min_mapq) & (F.col("chrom") != "chrM")).groupBy(*TRACK, F.expr(f"ref_start div {width}").alias("bin_idx")).agg(F.count(F.lit(1)).alias("n"))
    # the reads are counted once; what is kept are the bins
    return scale_bins(keep(counts), ploidy)


def scale_bins(counts: DataFrame, ploidy: float = 2.0) -> DataFrame:
    last = counts.groupBy(*TRACK).agg(F.max("bin_idx").alias("_last"), F.sum("n").alias("_sum"))
    mean = last.filter(is_autosome(F.col("chrom"))).groupBy("sample_id").agg((F.sum("_sum") / F.sum(F.col("_last") + 1)).alias("_mean"))
    grid = last.select(*TRACK, F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("bin_idx"))
    full = grid.join(counts, [*TRACK, "bin_idx"], "left").join(mean, "sample_id")
    return full.select(*TRACK, "bin_idx", (ploidy * F.coalesce("n", F.lit(0)) / F.col("_mean")).alias("value"))


def moving_average(track: DataFrame, n: int = 3) -> DataFrame:
    """Centred mean over an odd number of bins; edge values are repeated."""
    if n % 2 == 0:
        raise ValueError("the window needs an odd number of bins")
    h = n // 2
    order = Window.partitionBy(*TRACK).orderBy("bin_idx")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.row_number().over(order)
    size = F.count(F.lit(1)).over(Window.partitionBy(*TRACK))
    before, after = F.greatest(F.lit(0), h + 1 - at), F.greatest(F.lit(0), at + h - size)
    total = F.sum("value").over(order.rowsBetween(-h, h)) + before * F.first("value").over(whole) + after * F.last("value").over(whole)
    return track.withColumn("value", total / n)


def normalise_cnv(track: DataFrame, reference: DataFrame, n: int = 3) -> DataFrame:
    """Smoothed sample minus smoothed reference for chromosomes both have; missing bins are 0."""
    ref = moving_average(reference.withColumn("sample_id", F.lit("")).select(*TRACK, "bin_idx", "value"), n).select("chrom", "bin_idx", F.col("value").alias("_ref"))
    ref_chroms = ref.select("chrom").distinct()
    mine = moving_average(track.filter("chrom <> 'chrM'"), n).join(ref_chroms, "chrom", "left_semi")
    wanted = mine.select(*TRACK).distinct().join(ref, "chrom")
    joined = mine.join(wanted, [*TRACK, "bin_idx"], "full")
    return keep(joined.select(*TRACK, "bin_idx", (F.coalesce("value", F.lit(0.0)) - F.coalesce("_ref", F.lit(0.0))).alias("value")))


def significant_regions(track: DataFrame, threshold: float = 0.5, width: int = 1_000_000) -> DataFrame:
    """Runs of neighbouring bins beyond the threshold with one sign."""
    rows = track.filter(F.abs("value") > threshold).withColumn("type", F.when(F.col("value") > 0, "gain").otherwise("loss"))
    run = F.col("bin_idx") - F.row_number().over(Window.partitionBy(*TRACK, "type").orderBy("bin_idx"))
    out = rows.withColumn("_run", run).groupBy(*TRACK, "type", "_run").agg(F.min("bin_idx").alias("a"), F.max("bin_idx").alias("b"))
    return out.select(*TRACK, "type", (F.col("a") * width).alias("start_pos"), ((F.col("b") + 1) * width).alias("end_pos"))


def chrom_stats(track: DataFrame, sex: DataFrame | None = None) -> DataFrame:
    """Mean, population deviation and range per chromosome with the autosomal level.

    With ``sex`` (``sample_id, sex``) the expected level of X and Y is added.
    """
    v = F.col("value")
    per = track.groupBy(*TRACK).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("length"))
    level = per.filter(is_autosome(F.col("chrom"))).groupBy("sample_id").agg(F.avg("mean").alias("autosome_mean"), F.stddev_pop("mean").alias("autosome_std"))
    out = per.join(level, "sample_id")
    if sex is None:
        return out
    base = F.when((F.col("chrom") == "chrX") & (F.col("sex") == "XX"), 1.0).when((F.col("chrom") == "chrY") & (F.col("sex") != "XY"), -1.0).otherwise(0.0)
    return out.join(sex, "sample_id").withColumn("baseline", base)


def estimate_sex(track: DataFrame) -> DataFrame:
    """Sex from the nonzero means of X and Y; the rules are tried in order."""
    def mean(chrom):
        return F.avg(F.when((F.col("chrom") == chrom) & (F.col("value") != 0), F.col("value")))

    x, y = F.col("x_mean"), F.col("y_mean")
    call = (
        F.when(x.isNull() | y.isNull(), "Unknown")
        .when((x >= 0.1) & (y <= -0.1), "Female")
        .when((x <= 0.1) & (y >= -0.2), "Male")
        .when((x >= 0.1) & (y >= -0.1), "Male (query X/Y copy number changes)")
        .when((x < 0.1) & (y < -0.2), "Unknown (Query XY copy number changes)")
        .otherwise("Unknown")
    )
    return track.groupBy("sample_id").agg(mean("chrX").alias("x_mean"), mean("chrY").alias("y_mean")).withColumn("sex", call)


def bins_to_bands(track: DataFrame, bands: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Every band with the bins from its first to its last base, both included."""
    side = bands.select("chrom", "band", F.col("start_pos").alias("band_start"), F.col("end_pos").alias("band_end"),
                        F.explode(F.sequence(F.expr(f"start_pos div {width}"), F.expr(f"end_pos div {width}"))).alias("bin_idx"))
    return track.join(side, ["chrom", "bin_idx"])


def threshold(sex: Column, chrom: Column, which: str) -> Column:
    i = 0 if which == "gain" else 1
    male = F.upper(sex).isin("XY", "MALE")
    t = CNV_THRESHOLDS
    return (
        F.when((chrom == "chrX") & male, t["chrX male"][i]).when(chrom == "chrX", t["chrX female"][i])
        .when((chrom == "chrY") & male, t["chrY male"][i]).when(chrom == "chrY", t["chrY female"][i]).otherwise(t["autosome"][i])
    )


def arm_stats(track: DataFrame, bands: DataFrame, sex: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Mean and affected share of each arm, by the first letter of the band."""
    rows = bins_to_bands(track, bands, width).join(sex.select("sample_id", "sex"), "sample_id")
    rows = rows.withColumns({"arm": F.substring("band", 1, 1), "gain": threshold(F.col("sex"), F.col("chrom"), "gain"), "loss": threshold(F.col("sex"), F.col("chrom"), "loss")})
    rows = rows.filter(F.col("arm").isin("p", "q"))

    def share(cond):
        return F.avg(F.when(cond, 1.0).otherwise(0.0))

    return rows.groupBy(*TRACK, "arm").agg(
        F.avg("value").alias("mean"), F.greatest(share(F.col("value") > F.col("gain")), share(F.col("value") < F.col("loss"))).alias("share"),
        F.min("band_start").alias("start_pos"), F.max("band_end").alias("end_pos"), F.first("sex").alias("sex"), F.first("gain").alias("gain"), F.first("loss").alias("loss"),
    )


def cnv_events(track: DataFrame, bands: DataFrame, sex: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Whole-chromosome, arm and single-arm gains and losses."""
    if width > MAX_BIN_WIDTH:
        raise ValueError("the bins are too wide for events")
    arms = arm_stats(track, bands, sex, width)
    means = track.groupBy(*TRACK).agg(F.avg("value").alias("chrom_mean"))

    def of(arm, c):
        return F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{arm}_{c}")

    wide = arms.groupBy(*TRACK).agg(
        *[of(a, c) for a in ("p", "q") for c in ("mean", "share", "start_pos", "end_pos")], F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"),
        F.max("gain").alias("gain"), F.max("loss").alias("loss"), F.first("sex").alias("sex"),
    ).join(means, TRACK)
    male = F.upper("sex").isin("XY", "MALE")
    wide = wide.filter(F.col("chrom").startswith("chr") & (F.col("chrom") != "chrM") & ~((F.col("chrom") == "chrY") & male))
    pm, qm, ps, qs, gain, loss = (F.col(c) for c in ("p_mean", "q_mean", "p_share", "q_share", "gain", "loss"))
    both = pm.isNotNull() & qm.isNotNull()
    enough = (F.greatest(ps, qs) > 0.7) & (F.least(ps, qs) > 0.4)
    whole = F.when(both & enough & (pm > gain) & (qm > gain), "GAIN").when(both & enough & (pm < loss) & (qm < loss), "LOSS")
    single = F.when(~both & (F.abs("chrom_mean") > F.abs("gain") * 1.5), F.when(F.col("chrom_mean") > gain, "GAIN").otherwise("LOSS"))

    def event(kind, arm, mean, start, end, confidence, share):
        return F.when(kind.isNotNull(), F.struct(
            kind.alias("event_type"), F.lit(arm).alias("arm"), mean.alias("mean_cnv"), F.col(start).alias("start_pos"), F.col(end).alias("end_pos"), confidence.alias("confidence"), share.alias("share")
        ))

    def level(cond):
        return F.when(cond, "High").otherwise("Medium")

    items = [
        event(F.concat(F.lit("WHOLE_CHR_"), whole), "", F.col("chrom_mean"), "start_pos", "end_pos", level(F.least(ps, qs) > 0.8), F.greatest(ps, qs)),
        event(F.concat(F.lit("WHOLE_CHR_"), single), "", F.col("chrom_mean"), "start_pos", "end_pos", F.lit("Medium"), F.lit(1.0)),
    ]
    for arm, m, s in (("p", pm, ps), ("q", qm, qs)):
        kind = F.when(both & (F.col("chrom") != "chrY") & (s > 0.4), F.when(m > gain, "GAIN").when(m < loss, "LOSS"))
        items.append(event(kind, arm, m, f"{arm}_start_pos", f"{arm}_end_pos", level(s > 0.8), s))
    return wide.select(*TRACK, F.explode(F.array_compact(F.array(*items))).alias("e")).select(*TRACK, "e.*")


def with_gene_counts(spans: DataFrame, genes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of distinct genes touching each closed span."""
    side = genes.select("chrom", "gene", F.col("start_pos").alias("_gs"), F.col("end_pos").alias("_ge"))
    hit = interval_join(spans, side, left_span=("start_pos", "end_pos"), right_span=("_gs", "_ge"), closed=True, width=1 << 20)
    n = hit.select(*keys, "gene").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return spans.join(n, list(keys), "left").withColumn("n_genes", F.coalesce("_n", F.lit(0))).drop("_n")


def cnv_summary(events: DataFrame, genes: DataFrame) -> DataFrame:
    """Event counts by class and confidence, and the distinct genes they touch, per sample."""
    keys = [*TRACK, "event_type", "arm"]
    counted = with_gene_counts(events, genes, keys)
    base = counted.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("event_type").startswith("WHOLE_CHR_")).alias("whole_chromosome_events"),
        F.count_if(~F.col("event_type").startswith("WHOLE_CHR_")).alias("arm_events"), F.count_if(F.col("n_genes") > 0).alias("gene_containing_events"),
        F.count_if(F.col("confidence") == "High").alias("high_confidence_events"), F.count_if(F.col("confidence") == "Medium").alias("medium_confidence_events"),
    )
    side = genes.select("chrom", "gene", F.col("start_pos").alias("_gs"), F.col("end_pos").alias("_ge"))
    hit = interval_join(events, side, left_span=("start_pos", "end_pos"), right_span=("_gs", "_ge"), closed=True, width=1 << 20)
    n = hit.select("sample_id", "gene").distinct().groupBy("sample_id").agg(F.count(F.lit(1)).alias("total_genes"))
    return base.join(n, "sample_id", "left").fillna(0, ["total_genes"])


def cytoband_states(track: DataFrame, bands: DataFrame, centromeres: DataFrame, sex: DataFrame, width: int = 1_000_000, mode: str = "data") -> DataFrame:
    """Runs of bands in one state, and whole-chromosome states.

    ``mode="data"`` takes thresholds from the masked track and drops normal
    runs; ``mode="fixed"`` takes the threshold table and keeps them.
    """
    mask = centromeres.select("chrom", F.explode(F.when(F.expr(f"end_pos div {width} > start_pos div {width}"), F.sequence(F.expr(f"start_pos div {width}"), F.expr(f"end_pos div {width} - 1"))))
                              .alias("bin_idx"))
    masked = track.join(mask, ["chrom", "bin_idx"], "left_anti")
    stats = masked.groupBy(*TRACK).agg(F.avg("value").alias("chr_mean"), F.stddev_pop("value").alias("chr_std"))
    stats = keep(stats.join(sex.select("sample_id", "sex"), "sample_id"))
    if mode == "data":
        level = stats.filter(is_autosome(F.col("chrom"))).groupBy("sample_id").agg(F.avg("chr_mean").alias("_m"), F.stddev_pop("chr_mean").alias("_s"))
        k = F.when((F.col("chrom") == "chrY") & ~F.col("sex").isin("Male", "XY"), 1.2).otherwise(1.0)
        stats = stats.join(level, "sample_id").withColumns({
            "w_gain": F.col("_m") + k * F.col("_s"), "w_loss": F.col("_m") - k * F.col("_s"),
            "b_gain": F.col("chr_mean") + k * F.col("chr_std"), "b_loss": F.col("chr_mean") - k * F.col("chr_std"),
        }).drop("_m", "_s")
        judged = masked
    else:
        gain, loss = threshold(F.col("sex"), F.col("chrom"), "gain"), threshold(F.col("sex"), F.col("chrom"), "loss")
        stats = stats.withColumns({"w_gain": gain, "w_loss": loss, "b_gain": gain, "b_loss": loss})
        judged = track

    def share(cond):
        return F.avg(F.when(cond, 1.0).otherwise(0.0))

    shares = judged.join(stats, TRACK).groupBy(*TRACK).agg(share(F.col("value") > F.col("w_gain")).alias("up"), share(F.col("value") < F.col("w_loss")).alias("down"))
    whole = F.when(F.col("up") > 0.7, "GAIN").when(F.col("down") > 0.7, "LOSS")
    extent = bands.groupBy("chrom").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    chroms = shares.withColumn("state", whole).filter("state IS NOT NULL").join(stats.select(*TRACK, "chr_mean"), TRACK).join(extent, "chrom")
    chroms = chroms.select(*TRACK, "start_pos", "end_pos", F.concat("chrom", F.lit(" WHOLE CHROMOSOME "), "state").alias("name"), F.col("chr_mean").alias("mean_cnv"), "state")

    per_band = bins_to_bands(track, bands, width).groupBy(*TRACK, "band", "band_start", "band_end").agg(F.avg("value").alias("mean_cnv")).join(stats, TRACK)
    state = F.when(F.col("mean_cnv") > F.col("b_gain"), "GAIN").when(F.col("mean_cnv") < F.col("b_loss"), "LOSS").otherwise("NORMAL")
    runs = state_runs(per_band.withColumn("state", state))
    if mode == "data":
        runs = runs.filter("state <> 'NORMAL'")
    return runs.unionByName(chroms).withColumn("length", F.col("end_pos") - F.col("start_pos"))


def state_runs(bands: DataFrame) -> DataFrame:
    """Neighbouring bands of one state become one row labelled ``first-last``."""
    order = Window.partitionBy(*TRACK).orderBy("band_start")
    fresh = F.coalesce((F.lag("state").over(order) != F.col("state")).cast("int"), F.lit(1))
    rows = bands.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*TRACK, "_run", "state").agg(
        F.min("band_start").alias("start_pos"), F.max("band_end").alias("end_pos"), F.min_by("band", "band_start").alias("_a"), F.max_by("band", "band_start").alias("_z"), F.avg("mean_cnv").alias("mean_cnv")
    )
    return out.select(*TRACK, "start_pos", "end_pos", F.concat("chrom", F.lit(" "), "_a", F.lit("-"), "_z").alias("name"), "mean_cnv", "state")


def gained_lost_genes(states: DataFrame, genes: DataFrame) -> DataFrame:
    """Distinct genes in gained and lost runs, per chromosome."""
    side = genes.select("chrom", "gene", F.col("start_pos").alias("_gs"), F.col("end_pos").alias("_ge"))
    changed = states.filter(F.col("state").isin("GAIN", "LOSS"))
    hit = interval_join(changed, side, left_span=("start_pos", "end_pos"), right_span=("_gs", "_ge"), closed=True, width=1 << 20)
    per = hit.select(*TRACK, "state", "gene").distinct()
    return per.groupBy(*TRACK).agg(F.count_if(F.col("state") == "GAIN").alias("gained_genes"), F.count_if(F.col("state") == "LOSS").alias("lost_genes"))


def zscore_class(track: DataFrame, limit: float = 0.5, expected: float | None = None) -> DataFrame:
    """high, low or normal against the autosomes, or against an expected value per chromosome."""
    if expected is None:
        stats = track.filter(is_autosome(F.col("chrom"))).groupBy("sample_id").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
        rows = track.join(stats, "sample_id")
    else:
        stats = track.groupBy(*TRACK).agg(F.stddev_pop("value").alias("_s"))
        rows = track.join(stats, TRACK).withColumn("_m", F.lit(expected))
    z = F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return rows.withColumn("class", F.when(z > limit, "high").when(z < -limit, "low").otherwise("normal")).drop("_m", "_s")


def even_sample(track: DataFrame, k: int) -> DataFrame:
    """``k`` evenly spaced rows per chromosome; shorter tracks stay whole."""
    at = (F.row_number().over(Window.partitionBy(*TRACK).orderBy("bin_idx")) - 1).cast("bigint")
    size = F.count(F.lit(1)).over(Window.partitionBy(*TRACK))
    rows = track.withColumns({"_i": at, "_n": size})
    if k == 1:
        return rows.filter("_i = _n div 2").drop("_i", "_n")
    # row i is taken when it is the rounded place of one of the k steps around it
    step = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("_i") - 1) * (k - 1) / (F.col("_n") - 1))), F.ceil((F.col("_i") + 1) * (k - 1) / (F.col("_n") - 1)))
    hit = F.exists(step, lambda s: (s < k) & (F.rint(s * (F.col("_n") - 1) / (k - 1)) == F.col("_i")))
    return rows.filter((F.col("_n") <= k) | hit).drop("_i", "_n")


def apportioned(sizes: DataFrame, budget: int, within: Sequence[str], series: Sequence[str]) -> DataFrame:
    """Adds ``share``: how many of ``budget`` places each series of a group gets, by its rows ``n``.

    Every series gets one place, the largest first where there are too few; the others
    go by size, rounded down, and what is left by the largest remainders (ties in series
    order). The shares of a group add up to the budget, or to all rows if those are fewer.
    One row per series meets in a window, never the points themselves.
    """
    group = Window.partitionBy(*within)
    largest = Window.partitionBy(*within).orderBy(F.desc("n"), *series)
    counted = sizes.withColumns({"_total": F.sum("n").over(group), "_series": F.count(F.lit(1)).over(group), "_at": F.row_number().over(largest)})
    spare = F.greatest(F.lit(0), budget - F.col("_series"))
    room = F.greatest(F.lit(1), F.col("_total") - F.col("_series"))
    split = counted.withColumn("_quota", spare * (F.col("n") - 1)).withColumn("_room", room)
    split = split.withColumns({"_down": F.expr("_quota div _room"), "_left": F.col("_quota") % F.col("_room")})
    order = Window.partitionBy(*within).orderBy(F.desc("_left"), *series)
    split = split.withColumns({"_rest": spare - F.sum("_down").over(group), "_turn": F.row_number().over(order)})
    share = F.when(F.col("_total") <= budget, F.col("n")).when(F.col("_series") > budget, (F.col("_at") <= budget).cast("bigint")).otherwise(1 + F.col("_down") + (F.col("_turn") <= F.col("_rest")).cast("bigint"))
    return split.select(*sizes.columns, share.cast("bigint").alias("share"))


def even_sample_budget(track: DataFrame, budget: int) -> DataFrame:
    """``budget`` rows of a sample, spread over its chromosomes by their length and evenly within each.

    Of a chromosome with ``k`` of ``n`` rows, place ``s`` is row ``s (n - 1) / (k - 1)``,
    halves up; a single place is the middle row.
    """
    shares = apportioned(keep(track.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"))), budget, ["sample_id"], ["chrom"]).filter("share > 0")
    places = shares.select(*TRACK, "n", "share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("share") - 1)).alias("s"))
    at = F.when(F.col("share") == 1, F.expr("n div 2")).otherwise(F.expr("(2 * s * (n - 1) + share - 1) div greatest(1, 2 * (share - 1))"))
    rows = track.withColumn("_i", (F.row_number().over(Window.partitionBy(*TRACK).orderBy("bin_idx")) - 1).cast("bigint"))
    return rows.join(places.select(*TRACK, at.alias("_i")), [*TRACK, "_i"]).drop("_i")


#: Narrowest bins, levels of doubled width, and reads that an autosomal bin should hold on average.
BASE_WIDTH, WIDTH_LEVELS, READS_PER_BIN = 125_000, 7, 30


def base_counts(starts: DataFrame, min_mapq: int = 60, base: int = BASE_WIDTH) -> DataFrame:
    """Starts per narrowest bin; parts of a sample's files are counted apart and added up."""
    rows = starts.filter((F.col("mapq") >= min_mapq) & (F.col("chrom") != "chrM"))
    return rows.groupBy(*TRACK, F.expr(f"ref_start div {base}").alias("bin_idx")).agg(F.count(F.lit(1)).alias("n"))


def fitted_bins(counts: DataFrame, reads_per_bin: int = READS_PER_BIN, base: int = BASE_WIDTH, levels: int = WIDTH_LEVELS) -> DataFrame:
    """Counts of each sample on the bin width that its own depth allows: ``sample_id, width, chrom, bin_idx, n``.

    ``counts`` are narrowest bins of any number of parts. Widths are the base times powers
    of two; a sample takes the narrowest on which its autosomal bins, empty ones included,
    hold ``reads_per_bin`` on average, or the widest. Coarser bins are sums of narrower
    ones, so the reads are counted once.
    """
    counts = keep(counts.groupBy(*TRACK, "bin_idx").agg(F.sum("n").alias("n")))
    lasts = counts.filter(is_autosome(F.col("chrom"))).groupBy(*TRACK).agg(F.max("bin_idx").alias("_last"), F.sum("n").alias("_n"))
    bins = [F.sum(F.shiftright("_last", k) + 1).alias(f"_bins{k}") for k in range(levels)]
    depth = lasts.groupBy("sample_id").agg(F.sum("_n").alias("_n"), *bins)
    level = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        level = F.when(F.col("_n") >= reads_per_bin * F.col(f"_bins{k}"), k).otherwise(level)
    chosen = counts.join(depth.select("sample_id", level.alias("_level")), "sample_id")
    coarse = chosen.groupBy(*TRACK, (base * F.pow(F.lit(2.0), "_level")).cast("bigint").alias("width"), F.expr("shiftright(bin_idx, _level)").alias("bin_idx")).agg(F.sum("n").alias("n"))
    return coarse.select("sample_id", "width", "chrom", "bin_idx", "n")


def width_and_variance(bins: DataFrame, ploidy: float = 2.0) -> DataFrame:
    """Per sample its width, autosomal bins and reads, and the variance between neighbouring bins.

    The variance is half the mean squared difference of neighbouring values, empty bins
    included, so real changes of level count once and noise counts everywhere.
    """
    auto = keep(bins.filter(is_autosome(F.col("chrom"))))
    last = auto.groupBy("sample_id", "width", "chrom").agg(F.max("bin_idx").alias("_last"), F.sum("n").alias("_n"))
    mean = last.groupBy("sample_id", "width").agg(F.sum(F.col("_last") + 1).alias("bins"), F.sum("_n").alias("reads"))
    grid = last.select(*TRACK, F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("bin_idx")).join(auto.select(*TRACK, "bin_idx", "n"), [*TRACK, "bin_idx"], "left")
    before = F.lag(F.coalesce("n", F.lit(0))).over(Window.partitionBy(*TRACK).orderBy("bin_idx"))
    steps = grid.withColumn("_d", F.coalesce("n", F.lit(0)) - before).groupBy("sample_id").agg(F.sum(F.col("_d") * F.col("_d")).alias("_sq"), F.count("_d").alias("_pairs"))
    level = ploidy * F.col("bins") / F.col("reads")
    return mean.join(steps, "sample_id").select("sample_id", "width", "bins", "reads", (level * level * F.col("_sq") / (2 * F.col("_pairs"))).alias("variance"))


def downsample_mean(track: DataFrame, group: int, width: int = 1_000_000) -> DataFrame:
    """Means over groups of bins at the centre of each group; a last, smaller group counts too.

    A chromosome shorter than one group stays as it is, bin by bin.
    """
    n = track.groupBy(*TRACK).agg((F.max("bin_idx") + 1).alias("_n"))
    size = F.when(F.col("_n") < group, 1).otherwise(group)
    rows = track.join(n, TRACK).withColumn("_size", size.cast("bigint")).withColumn("_g", F.expr("bin_idx div _size"))
    out = rows.groupBy(*TRACK, "_g", "_size", "_n").agg(F.avg("value").alias("value"))
    first = F.col("_g") * F.col("_size")
    return out.select(*TRACK, ((first + F.least(first + F.col("_size"), "_n")) / 2.0 * width).alias("position"), "value")


def random_sample(rows: DataFrame, share: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """About ``share`` of the rows, those whose digest is low: the same ones for the same seed on any cluster, without a sort."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    return rows.filter(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32)))


def _best_splits(signal: np.ndarray, penalty: float, min_size: int = 2) -> list[int]:
    """Ends of the segments with the least squared error plus ``penalty`` per change."""
    n = len(signal)
    s1 = np.concatenate([[0.0], np.cumsum(signal)])
    s2 = np.concatenate([[0.0], np.cumsum(signal**2)])
    cost = np.full(n + 1, np.inf)
    cost[0] = -penalty
    back = np.zeros(n + 1, dtype=int)
    starts = np.array([0])
    beaten: dict[int, np.ndarray] = {}
    for end in range(min_size, n + 1):
        # a start beaten at an earlier end can be dropped once a new segment fits in between
        starts = np.setdiff1d(starts, beaten.pop(end - min_size, np.array([], dtype=int)))
        width = end - starts
        total = s1[end] - s1[starts]
        value = cost[starts] + s2[end] - s2[starts] - total**2 / width + penalty
        best = int(np.argmin(value))
        cost[end], back[end] = value[best], starts[best]
        beaten[end] = starts[value - penalty > cost[end]]
        starts = np.append(starts, end - min_size + 1)
    ends, at = [], n
    while at > 0:
        ends.append(at)
        at = back[at]
    return sorted(ends)


def change_points(track: DataFrame, penalty: float = 10.0, width: int = 1_000_000) -> DataFrame:
    """Mean shifts per chromosome as one-bin margins around each segment end.

    A group is one chromosome of one sample, at most its length over the bin
    width; shorter tracks than four bins and chrM are left out.
    """
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin_idx")
        if len(pdf) <= 3:
            return pd.DataFrame({"sample_id": [], "chrom": [], "start_pos": [], "end_pos": []})
        ends = np.array(_best_splits(pdf["value"].to_numpy(dtype=float), penalty))
        out = pd.DataFrame({"start_pos": ends * width - width, "end_pos": ends * width + width})
        out.insert(0, "chrom", pdf["chrom"].iloc[0])
        out.insert(0, "sample_id", pdf["sample_id"].iloc[0])
        return out[out["start_pos"] >= 0]

    return track.filter("chrom <> 'chrM'").groupBy(*TRACK).applyInPandas(split, "sample_id string, chrom string, start_pos long, end_pos long")
