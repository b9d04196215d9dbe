"""Methylation queries on the given tables."""

from pyspark.sql import functions as F

from strandline.functions.tiers import methylation_tier, mgmt_status
from strandline.operators import methylation as me
from strandline.operators import qc
from strandline.operators import scores as sc
from strandline.plans.registry import query
from strandline.session import scratch_path
from strandline.sinks import layouts as lay
from strandline.sources.text import parse_vcf

PER_CODE = """by_code AS (SELECT sample_id, read_id, chrom, pos, strand, mod_code, max(prob) AS p FROM mod_calls GROUP BY ALL)"""
COMBINED = f"""{PER_CODE}, per_read AS (SELECT sample_id, read_id, chrom, pos, strand, CAST(greatest(0, 255 - sum(CASE WHEN mod_code <> 'C' THEN p ELSE 0 END)) AS BIGINT) AS c,
    max(CASE WHEN mod_code = 'm' THEN p ELSE 0 END) AS m, max(CASE WHEN mod_code = 'h' THEN p ELSE 0 END) AS h FROM by_code GROUP BY 1, 2, 3, 4, 5),
  called AS (SELECT *, CASE WHEN greatest(c, m, h) >= 186 AND c = greatest(c, m, h) THEN 'canonical' WHEN greatest(c, m, h) >= 186 THEN 'mod' WHEN greatest(c, m, h) = 0 THEN 'canonical' ELSE 'fail' END AS call FROM per_read),
  combined AS (SELECT sample_id, chrom, pos, strand, count(*) AS valid_cov, count(*) FILTER (call = 'mod') AS n_mod, count(*) FILTER (call = 'canonical') AS n_canonical, count(*) FILTER (call = 'fail') AS n_fail,
    max(c) AS max_prob_c, max(m) AS max_prob_m, max(h) AS max_prob_h, 100.0E0 * count(*) FILTER (call = 'mod') / count(*) AS percent_modified FROM called GROUP BY 1, 2, 3, 4)"""
BY_CODE = f"""{PER_CODE}, marked AS (SELECT *, sum(CASE WHEN p >= 186 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, read_id, chrom, pos, strand) - CASE WHEN p >= 186 THEN 1 ELSE 0 END AS o FROM by_code),
  calls AS (SELECT *, CASE WHEN p >= 186 THEN 'mod' WHEN o > 0 THEN 'other_mod' WHEN p = 0 THEN 'canonical' ELSE 'fail' END AS call FROM marked),
  coded AS (SELECT sample_id, chrom, pos, strand, mod_code, count(*) AS valid_cov, count(*) FILTER (call = 'mod') AS n_mod, count(*) FILTER (call = 'canonical') AS n_canonical,
    count(*) FILTER (call = 'other_mod') AS n_other_mod, count(*) FILTER (call = 'fail') AS n_fail, 100.0E0 * count(*) FILTER (call = 'mod') / count(*) AS percent_modified FROM calls GROUP BY 1, 2, 3, 4, 5)"""


@query("AGG4_mod_site_counts_combined", f"WITH {COMBINED} SELECT * FROM combined")
def mod_site_counts_combined(v):
    return me.mod_site_counts_combined(v.mod_calls)


@query("AGG5_mod_site_counts_by_code", f"WITH {BY_CODE} SELECT * FROM coded")
def mod_site_counts_by_code(v):
    return me.mod_site_counts_by_code(v.mod_calls)


@query(
    "FLT2_qs_filter",
    """SELECT sample_id, read_id, chrom, ref_start, ref_end FROM alignments a WHERE NOT EXISTS (SELECT 1 FROM alignments p WHERE p.sample_id = a.sample_id AND p.read_id = a.read_id
       AND NOT p.is_secondary AND NOT p.is_supplementary AND p.qs < 12)""",
)
def qs_filter(v):
    return qc.qs_filter(v.alignments).select("sample_id", "read_id", "chrom", "ref_start", "ref_end")


@query(
    "FLT4_mod_code_filter",
    "SELECT sample_id, chrom, pos, strand, percent_modified / 100.0 AS fraction FROM meth_rows WHERE mod_code = 'm' AND pos <> -1 AND chrom <> '.'",
)
def mod_code_filter(v):
    return me.mod_code_filter(v.meth_rows).select("sample_id", "chrom", "pos", "strand", "fraction")


MM = """mm_reads AS (SELECT concat('f', CAST(l_suppkey AS STRING)) AS file, concat('r', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS read_id,
  CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 3 > 0 THEN CASE WHEN l_suppkey % 3 = 1 THEN 'C+m?,3,0;C+h?,1;' ELSE 'C+m:3,0;C+h:1;' END END AS mm FROM {lineitem})"""


@query(
    "FLT15_has_methylation_data",
    f"""WITH {MM}
        SELECT file, count(*) AS total_reads, count(mm) AS reads_with_mm, count(mm) >= 10 AND coalesce(bool_or(contains(mm, ':')), FALSE) AS has_data FROM mm_reads GROUP BY 1""",
)
def has_methylation_data(v):
    return me.has_methylation_data(v.sql(f"WITH {MM} SELECT * FROM mm_reads"))


MERGED = """merged AS (SELECT sample_id, chrom, pos, min(mod_code) AS mod_code, min(strand) AS strand, avg(percent_modified) AS percent_mean, CAST(sum(valid_cov) AS BIGINT) AS valid_cov,
  CAST(sum(n_mod) AS BIGINT) AS n_mod, CAST(sum(n_canonical) AS BIGINT) AS n_canonical, 100.0E0 * sum(n_mod) / sum(valid_cov) AS percent_weighted FROM meth_rows GROUP BY 1, 2, 3)"""
MINIMAL = """minimal AS (SELECT sample_id, chrom, pos AS start_pos, pos + 1 AS end_pos, mod_code, '.' AS strand, avg(percent_modified) AS fraction FROM meth_rows GROUP BY 1, 2, 3, 5)"""


@query("AGG6_merge_meth_state", f"WITH {MERGED} SELECT * FROM merged")
def merge_meth_state(v):
    return me.merge_meth_state(v.meth_rows)


@query("AGG7_collapse_minimal", f"WITH {MINIMAL} SELECT * FROM minimal ORDER BY chrom, start_pos")
def collapse_minimal(v):
    return me.collapse_minimal(v.meth_rows)


@query(
    "AGG8_merge_bedmethyl",
    """SELECT sample_id, chrom, pos, mod_code, '.' AS strand, CAST(sum(valid_cov) AS BIGINT) AS valid_cov, CAST(sum(n_mod) AS BIGINT) AS n_mod, CAST(sum(n_canonical) AS BIGINT) AS n_canonical,
       sum(n_mod) / sum(valid_cov) * 100 AS fraction FROM meth_rows GROUP BY 1, 2, 3, 4""",
)
def merge_bedmethyl(v):
    rows = v.meth_rows
    return me.merge_bedmethyl(rows.filter("strand = '+'"), rows.filter("strand = '-'"))


@query(
    "JN6_cpg_site_filter",
    """SELECT sample_id, file, chrom, pos, strand, mod_code, n_mod FROM meth_rows m WHERE EXISTS (SELECT 1 FROM probes p WHERE p.chrom = m.chrom AND p.start_pos <= m.pos AND m.pos < p.end_pos)""",
)
def cpg_site_filter(v):
    return me.cpg_site_filter(v.meth_rows, v.probes).select("sample_id", "file", "chrom", "pos", "strand", "mod_code", "n_mod")


SCORED = "scored AS (SELECT sample_id, read_id, chrom, pos, prob / 255.0E0 AS score FROM mod_calls WHERE mod_code = 'm')"


@query(
    "JN7_probe_margin_join",
    f"WITH {SCORED} SELECT c.sample_id, c.read_id, c.chrom, c.pos, c.score, p.probe_name, p.start_pos AS probe_start FROM scored c JOIN probes p ON p.chrom = c.chrom AND c.pos BETWEEN p.start_pos - 25 AND p.start_pos + 26",
)
def probe_margin_join(v):
    return me.probe_margin_join(v.sql(f"WITH {SCORED} SELECT * FROM scored"), v.probes)


@query(
    "AGG9_probe_calls",
    f"""WITH {SCORED}, signs AS (SELECT c.sample_id, c.chrom, p.probe_name, p.start_pos AS probe_start, CASE WHEN score > 0.7 THEN 1 ELSE -1 END AS s FROM scored c
          JOIN probes p ON p.chrom = c.chrom AND c.pos BETWEEN p.start_pos - 25 AND p.start_pos + 26 WHERE score > 0.7 OR score < 0.3),
        med AS (SELECT sample_id, chrom, probe_name, probe_start, CAST(trunc(median(s)) AS INT) AS f FROM signs GROUP BY 1, 2, 3, 4)
        SELECT sample_id, chrom, probe_name, probe_start, CASE WHEN f = 1 THEN 1 ELSE 0 END AS methylation_calls, CASE WHEN f = -1 THEN 1 ELSE 0 END AS unmethylation_calls, 1 AS total_calls FROM med WHERE f <> 0""",
)
def probe_calls(v):
    return me.probe_calls(v.sql(f"WITH {SCORED} SELECT * FROM scored"), v.probes)


@query("JN8_cpg_equi_join", f"WITH {MINIMAL} SELECT m.*, p.probe_name AS probe_id FROM minimal m JOIN probes p ON m.chrom = p.chrom AND m.start_pos = p.start_pos")
def cpg_equi_join(v):
    return me.cpg_equi_join(me.collapse_minimal(v.meth_rows), v.probes)


@query(
    "AGG10_cpg_features",
    f"""WITH {MINIMAL} SELECT sample_id, probe_name AS probe_id, CASE WHEN fraction >= 60 THEN 1 ELSE -1 END AS methylation_call
        FROM minimal m JOIN probes p ON m.chrom = p.chrom AND m.start_pos = p.start_pos WHERE mod_code = 'm'""",
)
def cpg_features(v):
    return me.cpg_features(me.collapse_minimal(v.meth_rows).filter("mod_code = 'm'"), v.probes)


FEATURES = f"""{MINIMAL}, features AS (SELECT sample_id, probe_name AS probe_id, CASE WHEN fraction >= 60 THEN 1 ELSE -1 END AS methylation_call
  FROM minimal m JOIN probes p ON m.chrom = p.chrom AND m.start_pos = p.start_pos WHERE mod_code = 'm')"""
#: a classifier's probe list; the last one is never measured
PROBE_LIST = [f"cg{i}" for i in range(1, 33)] + ["cg_none"]


CALLS = ", ".join(f"coalesce(max(methylation_call) FILTER (probe_id = '{p}'), 0) AS {p}" for p in PROBE_LIST)


@query("AGG10_feature_matrix", f"WITH {FEATURES} SELECT sample_id, {CALLS} FROM features GROUP BY 1")
def feature_matrix(v):
    return me.feature_matrix(cpg_features(v), PROBE_LIST)


@query(
    "AGG10_feature_blocks",
    f"""WITH {FEATURES}, best AS (SELECT sample_id, probe_id, max(methylation_call) AS c FROM features GROUP BY 1, 2),
        place AS (SELECT probe_name AS probe_id, min(chrom) AS chrom, CAST(floor(min(start_pos) / 1024.0E0) AS BIGINT) AS block FROM probes GROUP BY 1)
        SELECT sample_id, chrom, block, count(*) AS n_calls, string_agg(concat(probe_id, ':', c), ',' ORDER BY probe_id) AS calls FROM best JOIN place USING (probe_id) GROUP BY 1, 2, 3""",
)
def feature_blocks(v):
    """Every probe's call; maps as text, so that they compare whole."""
    text = F.transform(F.map_entries("calls"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return me.feature_blocks(cpg_features(v), v.probes).select("sample_id", "chrom", "block", F.size("calls").cast("bigint").alias("n_calls"), F.array_join(text, ",").alias("calls"))


@query("AGG48_measured_probes", f"WITH {FEATURES} SELECT sample_id, count(*) AS number_probes FROM features GROUP BY 1")
def measured_probes(v):
    return sc.measured_probes(cpg_features(v))


WINDOWS = "windows AS (SELECT chrom, start_pos - 60 AS start_pos, start_pos + 60 AS end_pos, probe_name AS window_id FROM probes)"


@query(
    "JN9_window_containment_join",
    f"""WITH {WINDOWS}, {MERGED} SELECT m.sample_id, m.chrom, m.pos, m.valid_cov, round(m.percent_weighted, 2) AS percent, w.window_id
        FROM merged m JOIN windows w ON w.chrom = m.chrom AND m.pos >= w.start_pos AND m.pos + 1 <= w.end_pos""",
)
def window_containment_join(v):
    rows = me.merge_meth_state(v.meth_rows).select("sample_id", "chrom", "pos", "valid_cov", F.round("percent_weighted", 2).alias("percent"))
    return me.windows_of_sites(rows, v.sql(f"WITH {WINDOWS} SELECT * FROM windows")).drop("start_pos", "end_pos")


PAIRS = "pairs AS (SELECT * FROM (VALUES (1, 129467254, 129467255), (2, 129467257, 129467258), (3, 129467261, 129467262), (4, 129467271, 129467272)) t(site, p1, p2))"
SITES = f"""{PAIRS}, per_strand AS (SELECT sample_id, chrom, pos, strand, CAST(sum(valid_cov) AS BIGINT) AS valid_cov, CAST(sum(n_mod) AS BIGINT) AS n_mod,
    100.0E0 * sum(n_mod) / sum(valid_cov) AS percent_modified FROM meth_rows GROUP BY 1, 2, 3, 4),
  hits AS (SELECT s.*, site FROM per_strand s JOIN pairs ON chrom = 'chr10' AND ((pos = p1 AND strand = '+') OR (pos = p2 AND strand = '-'))),
  sites AS (SELECT sample_id, site, CAST(coalesce(sum(valid_cov) FILTER (strand = '+'), 0) AS BIGINT) AS cov_fwd, CAST(coalesce(sum(valid_cov) FILTER (strand = '-'), 0) AS BIGINT) AS cov_rev,
    CAST(coalesce(sum(n_mod) FILTER (strand = '+'), 0) AS BIGINT) AS meth_fwd, CAST(coalesce(sum(n_mod) FILTER (strand = '-'), 0) AS BIGINT) AS meth_rev, CAST(sum(valid_cov) AS BIGINT) AS cov_total,
    round(sum(valid_cov * percent_modified) / sum(valid_cov), 2) AS meth FROM hits GROUP BY 1, 2)"""


def per_strand(v):
    rows = v.meth_rows.groupBy("sample_id", "chrom", "pos", "strand").agg(F.sum("valid_cov").alias("valid_cov"), F.sum("n_mod").alias("n_mod"))
    return rows.withColumn("percent_modified", 100.0 * F.col("n_mod") / F.col("valid_cov"))


@query("AGG11_mgmt_sites", f"WITH {SITES} SELECT * FROM sites")
def mgmt_sites(v):
    return me.mgmt_sites(per_strand(v))


@query("AGG12_mgmt_cohort", f"WITH {SITES} SELECT sample_id, site, cov_total, meth_fwd + meth_rev AS meth_total, round(100.0E0 * (meth_fwd + meth_rev) / cov_total, 2) AS percent FROM sites")
def mgmt_cohort(v):
    return me.mgmt_cohort(me.mgmt_sites(per_strand(v)))


@query(
    "FNC_methylation_tiers",
    f"""WITH {SITES}, c AS (SELECT sample_id, site, round(100.0E0 * (meth_fwd + meth_rev) / cov_total, 2) AS percent FROM sites)
        SELECT *, CASE WHEN percent > 10 THEN 'high' WHEN percent > 5 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN percent > 10 THEN 'Methylated' ELSE 'Unmethylated' END AS status FROM c""",
)
def methylation_tiers(v):
    rows = me.mgmt_cohort(me.mgmt_sites(per_strand(v))).select("sample_id", "site", "percent")
    return rows.withColumns({"tier": methylation_tier(F.col("percent")), "status": mgmt_status(F.col("percent") / 100)})


TAIL = "chr(9), CAST(n_mod AS STRING), chr(9), CAST(n_canonical AS STRING)"


@query(
    "SNK1_write_bedmethyl",
    f"""WITH {COMBINED} SELECT concat_ws(chr(9), chrom, pos, pos + 1, 'C', valid_cov, strand, pos, pos + 1, '255,0,0', valid_cov, printf('%.2f', percent_modified), n_mod, n_canonical, 0, 0, n_fail, 0, 0) AS value
        FROM combined WHERE n_mod > 0 OR n_canonical > 0""",
)
def write_bedmethyl(v):
    path = scratch_path(v.spark, "bedmethyl")
    lay.write_lines(lay.bedmethyl_lines(me.mod_site_counts_combined(v.mod_calls)), path)
    return v.spark.read.text(path)


def line_key():
    fields = F.split("value", "\t")
    return fields[0], fields[1].cast("bigint")


@query(
    "SNK1_ordered_parts",
    f"""WITH {COMBINED}, lines AS (SELECT chrom, pos, concat_ws(chr(9), chrom, pos, pos + 1, 'C', valid_cov, strand, pos, pos + 1, '255,0,0', valid_cov, printf('%.2f', percent_modified), n_mod, n_canonical, 0, 0, n_fail, 0, 0) AS value
        FROM combined WHERE n_mod > 0 OR n_canonical > 0) SELECT row_number() OVER (ORDER BY chrom, pos, value) AS line, value FROM lines""",
)
def ordered_parts(v):
    """Every line with its number over all parts, as the files hold it."""
    path = scratch_path(v.spark, "ordered")
    lay.write_ordered(lay.bedmethyl_lines(me.mod_site_counts_combined(v.mod_calls)), line_key(), path, rows_per_part=300)
    return lay.read_ordered(v.spark, path)


@query(
    "SNK3_ordered_range",
    """WITH lines AS (SELECT chrom, start_pos, concat_ws(chr(9), chrom, start_pos, end_pos) AS value FROM regions), numbered AS (SELECT *, row_number() OVER (ORDER BY chrom, start_pos, value) AS line FROM lines)
       SELECT line, value FROM numbered WHERE chrom = 'chr3' AND start_pos BETWEEN 100000 AND 120000""",
)
def ordered_range(v):
    """One stretch of a chromosome, from the parts that the manifest names."""
    path = scratch_path(v.spark, "ordered-bed")
    lay.write_ordered(lay.bed_lines(v.regions, 3), line_key(), path, rows_per_part=100)
    found = lay.read_ordered(v.spark, path, ("chr3", 100_000), ("chr3", 120_000))
    chrom, start = line_key()
    return found.filter((chrom == "chr3") & start.between(100_000, 120_000))


@query(
    "SNK2_write_meth_state",
    f"""WITH {BY_CODE} SELECT sample_id, chrom, pos AS "chromStart", mod_code, strand, valid_cov, CAST(printf('%.2f', percent_modified) AS DOUBLE) AS percent_modified, n_mod, n_canonical
        FROM coded WHERE n_mod > 0 OR n_canonical > 0""",
)
def write_meth_state(v):
    path = scratch_path(v.spark, "meth-state")
    lay.write_meth_state(me.mod_site_counts_by_code(v.mod_calls), path)
    return v.spark.read.parquet(path)


@query(
    "SNK3_write_bed",
    """SELECT concat_ws(chr(9), chrom, start_pos, end_pos) AS value, 3 AS columns FROM regions UNION ALL SELECT concat_ws(chr(9), chrom, start_pos, end_pos, name), 4 FROM regions
       UNION ALL SELECT concat_ws(chr(9), chrom, start_pos, end_pos, name, 0, strand), 6 FROM regions""",
)
def write_bed(v):
    from strandline.operators.ranges import genomic_sort

    rows = genomic_sort(v.regions.withColumn("score", F.lit(0)))
    path = scratch_path(v.spark, "bed")
    for n in (3, 4, 6):
        lay.write_lines(lay.bed_lines(rows, n), f"{path}/columns={n}")
    return v.spark.read.text(path)


@query(
    "SNK5_meth_to_bed18",
    """SELECT chrom, pos AS "chromStart", pos + 1 AS "chromEnd", mod_code, percent_modified AS score_bed, CASE WHEN strand = '.' THEN '+' ELSE strand END AS strand, pos AS "thickStart", pos + 1 AS "thickEnd",
       '255,0,0' AS color, valid_cov, percent_modified, n_mod, n_canonical, 0 AS n_othermod, 0 AS n_delete, 0 AS n_fail, 0 AS n_diff, 0 AS n_nocall FROM meth_rows""",
)
def meth_to_bed18(v):
    return lay.meth_to_bed18(v.meth_rows)


@query(
    "SNK6_meth_to_rf_input",
    f"""WITH {MINIMAL} SELECT chrom AS chr, start_pos AS start, end_pos AS "end", '.' AS dummy1, 0 AS dummy2, strand, '.' AS dummy3, 0 AS dummy4, '.' AS dummy5, 10 AS cov, fraction AS methylation_percent,
        CAST(round_even(fraction * 10 / 100, 0) AS BIGINT) AS n_mod, 10 - CAST(round_even(fraction * 10 / 100, 0) AS BIGINT) AS n_canonical FROM minimal""",
)
def meth_to_rf_input(v):
    return lay.meth_to_rf_input(me.collapse_minimal(v.meth_rows))


@query(
    "SNK7_mixed_delim",
    f"""WITH {COMBINED} SELECT concat_ws(chr(9), chrom, pos, pos + 1, 'C', valid_cov, strand, pos, pos + 1, '255,0,0', concat(valid_cov, ' ', printf('%.2f', percent_modified)), printf('%.2f', percent_modified), n_mod, n_canonical, 0, 0, n_fail, 0, 0) AS value
        FROM combined WHERE n_mod > 0 OR n_canonical > 0""",
)
def mixed_delim(v):
    return lay.mixed_delim(lay.bedmethyl_lines(me.mod_site_counts_combined(v.mod_calls)))


@query("SNK9_merge_vcfs", "SELECT chrom, pos, id, ref, alt, qual, filter, concat(info, ';NOTE=a#b') AS info, format, gt FROM vcf")
def merge_vcfs(v):
    from strandline.plans.source_queries import vcf_lines

    snv, indel = v.vcf.filter("length(alt) = 1"), v.vcf.filter("length(alt) > 1")
    merged = lay.merge_vcfs([parse_vcf(vcf_lines(snv)), parse_vcf(vcf_lines(indel))])
    path = scratch_path(v.spark, "variants")
    lay.write_vcf_table(merged, path)
    return v.spark.read.schema(merged.schema).option("header", True).csv(path)
