"""Methylation calls to site counts, merges, probe features and promoter sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.intervals import interval_join, window_containment

SITE = ["sample_id", "chrom", "pos", "strand"]
READ_SITE = ["sample_id", "read_id", "chrom", "pos", "strand"]

#: fixed values: the four CpG pairs (1-based) of the MGMT promoter test on chr10
MGMT_PAIRS = ((129467255, 129467256), (129467258, 129467259), (129467262, 129467263), (129467272, 129467273))


def probability_threshold(threshold: float = 0.73) -> int:
    return int(threshold * 255)


def mod_code_filter(state: DataFrame, code: str = "m") -> DataFrame:
    """Calls of one modification at known places, as fractions."""
    rows = state.filter((F.col("mod_code") == code) & (F.col("pos") != -1) & (F.col("chrom") != "."))
    return rows.withColumn("fraction", F.col("percent_modified") / 100.0)


def mod_site_counts_combined(calls: DataFrame, threshold: float = 0.73) -> DataFrame:
    """One call per read and site from the strongest of canonical, m and h.

    Read-site groups stay together after one exchange: both inner aggregates
    run on the same partitioning.
    """
    limit = probability_threshold(threshold)
    by_code = calls.repartition(*[F.col(c) for c in READ_SITE]).groupBy(*READ_SITE, "mod_code").agg(F.max("prob").alias("p"))
    modified = F.col("mod_code") != "C"

    def top(code):
        return F.coalesce(F.max(F.when(F.col("mod_code") == code, F.col("p"))), F.lit(0))

    per_read = by_code.groupBy(*READ_SITE).agg(
        F.greatest(F.lit(0), 255 - F.coalesce(F.sum(F.when(modified, F.col("p"))), F.lit(0))).alias("c"), top("m").alias("m"), top("h").alias("h")
    )
    best = F.greatest("c", "m", "h")
    call = (
        F.when((best >= limit) & (F.col("c") == best), "canonical").when(best >= limit, "mod").when(best == 0, "canonical").otherwise("fail")
    )
    site = per_read.withColumn("call", call).groupBy(*SITE)
    return _with_percent(site.agg(
        F.count(F.lit(1)).alias("valid_cov"),
        *[F.count_if(F.col("call") == k).alias(f"n_{k}") for k in ("mod", "canonical", "fail")],
        F.max("c").alias("max_prob_c"), F.max("m").alias("max_prob_m"), F.max("h").alias("max_prob_h"),
    ))


def _with_percent(counts: DataFrame) -> DataFrame:
    return counts.withColumn("percent_modified", F.when(F.col("valid_cov") > 0, 100.0 * F.col("n_mod") / F.col("valid_cov")).otherwise(0.0))


def mod_site_counts_by_code(calls: DataFrame, threshold: float = 0.73, reference: DataFrame | None = None) -> DataFrame:
    """Counts per modification; weak calls beside a strong other one are ``other_mod``."""
    limit = probability_threshold(threshold)
    if reference is not None:
        expected = F.when(F.col("mod_code").isin("m", "h"), "C").when(F.col("mod_code") == "a", "A")
        calls = calls.join(reference.select("chrom", "pos", "ref_base"), ["chrom", "pos"])
        calls = calls.filter(expected.isNull() | (F.upper("ref_base") == expected)).drop("ref_base")
    by_code = calls.repartition(*[F.col(c) for c in READ_SITE]).groupBy(*READ_SITE, "mod_code").agg(F.max("prob").alias("p"))
    # a read has a handful of codes at one site, so this window is tiny
    strong = (F.col("p") >= limit).cast("int")
    others = F.sum(strong).over(Window.partitionBy(*READ_SITE)) - strong
    call = (
        F.when(F.col("p") >= limit, "mod").when(others > 0, "other_mod").when(F.col("p") == 0, "canonical").otherwise("fail")
    )
    site = by_code.withColumn("call", call).groupBy(*SITE, "mod_code")
    return _with_percent(site.agg(
        F.count(F.lit(1)).alias("valid_cov"), *[F.count_if(F.col("call") == k).alias(f"n_{k}") for k in ("mod", "canonical", "other_mod", "fail")]
    ))


def merge_meth_state(rows: DataFrame) -> DataFrame:
    """One row per position: plain and weighted percent, summed counts, smallest code and strand."""
    return rows.groupBy("sample_id", "chrom", "pos").agg(
        F.min("mod_code").alias("mod_code"), F.min("strand").alias("strand"), F.avg("percent_modified").alias("percent_mean"),
        *[F.sum(c).alias(c) for c in ("valid_cov", "n_mod", "n_canonical")],
    ).withColumn("percent_weighted", 100.0 * F.col("n_mod") / F.col("valid_cov"))


def collapse_minimal(rows: DataFrame) -> DataFrame:
    """Strands unified, mean percent per position and modification, in order."""
    out = rows.groupBy("sample_id", "chrom", "pos", "mod_code").agg(F.avg("percent_modified").alias("fraction"))
    return out.select("sample_id", "chrom", F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"), "mod_code", F.lit(".").alias("strand"), "fraction")


BED_SUMS = ("valid_cov", "n_mod", "n_canonical", "n_othermod", "n_delete", "n_fail", "n_diff", "n_nocall", "score")


def collapse_bedmethyl(rows: DataFrame) -> DataFrame:
    """Strands unified, counts summed, percent from the sums."""
    sums = [c for c in BED_SUMS if c in rows.columns]
    out = rows.groupBy("sample_id", "chrom", "pos", "mod_code").agg(*[F.sum(c).alias(c) for c in sums])
    return out.withColumn("strand", F.lit(".")).withColumn("fraction", F.col("n_mod") / F.col("valid_cov") * 100)


def merge_bedmethyl(a: DataFrame, b: DataFrame) -> DataFrame:
    if set(a.columns) != set(b.columns):
        raise ValueError("both inputs need the same columns")
    return collapse_bedmethyl(a.unionByName(b))


def cpg_site_filter(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows whose base lies in a listed CpG; a row is never duplicated."""
    bases = sites.filter("end_pos > start_pos").select("chrom", F.explode(F.sequence("start_pos", F.col("end_pos") - 1)).alias("pos")).distinct()
    return rows.join(bases, ["chrom", "pos"], "left_semi")


def probe_margin_join(calls: DataFrame, probes: DataFrame, margin: int = 25) -> DataFrame:
    """Calls with ``start - margin <= pos <= start + margin + 1`` of a probe."""
    padded = probes.select("chrom", "probe_name", F.col("start_pos").alias("probe_start"), (F.col("start_pos") - margin).alias("_ps"), (F.col("start_pos") + margin + 2).alias("_pe"))
    points = calls.withColumn("_e", F.col("pos") + 1)
    return interval_join(points, padded, left_span=("pos", "_e"), right_span=("_ps", "_pe"), width=1024).drop("_e", "_ps", "_pe")


def probe_calls(calls: DataFrame, probes: DataFrame, margin: int = 25, low: float = 0.3, high: float = 0.7, score: str = "score") -> DataFrame:
    """Methylated (+1) or unmethylated (-1) per probe.

    The truncated median of signs is the sign of the majority, so two counts
    replace it and combine map-side.
    """
    s = F.col(score)
    hits = probe_margin_join(calls.filter((s > high) | (s < low)), probes, margin)
    per = hits.groupBy("sample_id", "chrom", "probe_name", "probe_start").agg(F.count_if(s > high).alias("_up"), F.count_if(s < low).alias("_down"))
    out = per.withColumns({"methylation_calls": (F.col("_up") > F.col("_down")).cast("bigint"), "unmethylation_calls": (F.col("_down") > F.col("_up")).cast("bigint")})
    out = out.withColumn("total_calls", F.col("methylation_calls") + F.col("unmethylation_calls"))
    return out.filter("total_calls > 0").drop("_up", "_down")


def cpg_equi_join(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows at the start of a listed probe."""
    side = probes.select("chrom", "start_pos", F.col("probe_name").alias("probe_id"))
    return rows.join(side, ["chrom", "start_pos"])


def cpg_features(rows: DataFrame, probes: DataFrame, threshold: float = 60.0) -> DataFrame:
    """+1 or -1 per sample and probe at ``threshold`` percent."""
    call = F.when(F.col("fraction") >= threshold, 1).otherwise(-1).cast("bigint")
    return cpg_equi_join(rows, probes).select("sample_id", "probe_id", call.alias("methylation_call"))


def feature_matrix(features: DataFrame, probe_ids: Sequence[str], missing: int = 0) -> DataFrame:
    """Wide rows for a known probe list; probes without a call get ``missing``."""
    wide = features.groupBy("sample_id").pivot("probe_id", list(probe_ids)).agg(F.max("methylation_call"))
    return wide.fillna(missing)


def feature_blocks(features: DataFrame, probes: DataFrame, size: int = 1024) -> DataFrame:
    """Feature vectors over every listed probe: one row per sample and block with a call.

    A block is ``size`` bases of a chromosome by the probe's start, so it is bounded
    by the genome and needs no order over all probes. ``calls`` maps a probe to its
    call; absent probes mean 0. Of several calls the highest counts.
    """
    place = probes.groupBy(F.col("probe_name").alias("probe_id")).agg(F.min(F.struct("chrom", F.floor(F.col("start_pos") / size).alias("block"))).alias("_at"))
    calls = features.groupBy("sample_id", "probe_id").agg(F.max("methylation_call").alias("methylation_call")).join(place, "probe_id")
    pair = F.struct("probe_id", "methylation_call")
    return calls.groupBy("sample_id", F.col("_at.chrom").alias("chrom"), F.col("_at.block").alias("block")).agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("calls"))


def windows_of_sites(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """CpG rows inside each reference window; every containing window matches."""
    return window_containment(rows, windows)


def mgmt_sites(rows: DataFrame) -> DataFrame:
    """Coverage and methylation of the promoter pairs per sample.

    The plus strand is read at the first and the minus strand at the second base
    (both shifted to 0-based); whether values are percent is decided per sample.
    """
    place = {}
    for i, (a, b) in enumerate(MGMT_PAIRS, 1):
        place[f"{a - 1}+"] = i
        place[f"{b - 1}-"] = i
    lookup = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    scale = rows.groupBy("sample_id").agg(F.max(F.col("percent_modified") > 1.0).alias("_pct"))
    wanted = rows.filter((F.col("chrom") == "chr10") & F.col("pos").isin([int(k[:-1]) for k in place]))
    wanted = wanted.withColumn("site", F.try_element_at(lookup, F.concat(F.col("pos").cast("string"), "strand"))).filter("site IS NOT NULL")
    fraction = F.col("percent_modified") / F.when(F.col("_pct"), 100.0).otherwise(1.0)
    fwd, rev = F.col("strand") == "+", F.col("strand") == "-"

    def total(cond, what):
        return F.coalesce(F.sum(F.when(cond, what)), F.lit(0))

    per = wanted.join(scale, "sample_id").groupBy("sample_id", "site").agg(
        total(fwd, F.col("valid_cov")).alias("cov_fwd"), total(rev, F.col("valid_cov")).alias("cov_rev"),
        total(fwd, F.col("n_mod")).alias("meth_fwd"), total(rev, F.col("n_mod")).alias("meth_rev"),
        F.sum(F.col("valid_cov") * fraction).alias("_w"), F.sum("valid_cov").alias("cov_total"),
    )
    return per.filter("cov_total > 0").withColumn("meth", F.round(F.col("_w") / F.col("cov_total") * 100.0, 2)).drop("_w")


def mgmt_cohort(sites: DataFrame) -> DataFrame:
    """All samples and sites with the methylated total and its percent of cover."""
    total = F.col("meth_fwd") + F.col("meth_rev")
    return sites.select("sample_id", "site", "cov_total", total.alias("meth_total"), F.round(100.0 * total / F.col("cov_total"), 2).alias("percent"))


def has_methylation_data(reads: DataFrame, key: str = "file", needed: int = 10) -> DataFrame:
    """Whether the reads of a file hold enough modification tags; all of them are read."""
    kinds = F.filter(F.transform(F.filter(F.split("mm", ";"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.substring_index(x, ":", 1)), lambda x: x != "")
    per = reads.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_reads"), F.count_if(F.col("mm").isNotNull()).alias("reads_with_mm"), F.max(F.coalesce(F.size(kinds), F.lit(0)) > 0).alias("_kinds")
    )
    return per.withColumn("has_data", (F.col("reads_with_mm") >= needed) & F.col("_kinds")).drop("_kinds")
