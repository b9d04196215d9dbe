"""Coverage tables, history and outliers on the given tables."""

from pyspark.sql import functions as F

from strandline.functions.chroms import canonical, is_standard
from strandline.functions.tiers import depth_tier
from strandline.operators import coverage as cv
from strandline.plans.interval_queries import GENOMIC_RANK_SQL, OVERLAP
from strandline.plans.registry import query

NATURAL = GENOMIC_RANK_SQL.format(c="chrom", x=23, y=24, m=25, o=1000)

SWEEP = """edges AS (SELECT sample_id, chrom, pos, sum(d) AS d, sum(r) AS r FROM (
    SELECT sample_id, chrom, ref_start AS pos, 1 AS d, 1 AS r FROM alignments WHERE NOT is_unmapped AND NOT is_secondary UNION ALL
    SELECT sample_id, chrom, ref_end, -1, 0 FROM alignments WHERE NOT is_unmapped AND NOT is_secondary) GROUP BY 1, 2, 3),
  swept AS (SELECT *, sum(d) OVER (PARTITION BY sample_id, chrom ORDER BY pos) AS depth, coalesce(lead(pos) OVER (PARTITION BY sample_id, chrom ORDER BY pos), pos) - pos AS w FROM edges),
  genome_cov AS (SELECT sample_id, chrom, CAST(1 AS BIGINT) AS start_pos, any_value(length) AS end_pos, CAST(sum(r) AS BIGINT) AS numreads,
    CAST(sum(CASE WHEN depth > 0 THEN w ELSE 0 END) AS BIGINT) AS covbases, CAST(sum(depth * w) AS DOUBLE) / any_value(length) AS meandepth FROM swept JOIN genome USING (chrom) GROUP BY 1, 2)"""


@query("AGG13_genome_coverage", f"WITH {SWEEP} SELECT * FROM genome_cov")
def genome_coverage(v):
    return cv.genome_coverage(v.alignments, v.genome)


@query(
    "AGG14_target_coverage",
    f"""SELECT s.sample_id, g.chrom, g.start_pos, g.end_pos, g.target_id AS name, g.end_pos - g.start_pos + 1 AS length,
        CAST(coalesce(sum(CASE WHEN a.read_id IS NOT NULL THEN least(a.ref_end, g.end_pos) - greatest(a.ref_start, g.start_pos) END), 0) AS BIGINT) AS bases,
        coalesce(sum(CASE WHEN a.read_id IS NOT NULL THEN least(a.ref_end, g.end_pos) - greatest(a.ref_start, g.start_pos) END), 0) / (g.end_pos - g.start_pos + 1) AS coverage
        FROM regions g JOIN (SELECT unnest(['s0', 's1', 's2']) AS sample_id) s ON TRUE
        LEFT JOIN alignments a ON a.sample_id = s.sample_id AND {OVERLAP.format(n=0)} AND NOT a.is_unmapped AND NOT a.is_secondary GROUP BY 1, 2, 3, 4, 5""",
)
def target_coverage(v):
    panel = v.regions.select("chrom", "start_pos", "end_pos", F.col("target_id").alias("name"))
    return cv.target_coverage(v.alignments, panel, samples=["s0", "s1", "s2"])


@query(
    "FLT5_standard_chroms",
    """SELECT sample_id, chrom, name, bases FROM target_coverage WHERE chrom <> 'chrM'""",
)
def standard_chroms(v):
    stripped = v.target_coverage.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    rows = stripped.withColumn("chrom", canonical(F.col("chrom"))).filter(is_standard(F.col("chrom")))
    return rows.select("sample_id", "chrom", "name", "bases")


@query("FNC_depth_tiers", "SELECT sample_id, chrom, start_pos, name, CASE WHEN coverage >= 30 THEN 'high' WHEN coverage >= 20 THEN 'medium' ELSE 'low' END AS tier FROM target_coverage")
def depth_tiers(v):
    return v.target_coverage.select("sample_id", "chrom", "start_pos", "name", depth_tier(F.col("coverage")).alias("tier"))


@query("FLT9_targets_over_threshold", "SELECT sample_id, name, coverage FROM target_coverage WHERE coverage >= 10")
def targets_over_threshold(v):
    return cv.targets_over_threshold(v.target_coverage, 10).select("sample_id", "name", "coverage")


@query(
    "JN14_coverage_merge",
    """SELECT sample_id, chrom, start_pos, end_pos, CAST(sum(numreads) AS BIGINT) AS numreads, CAST(sum(covbases) AS BIGINT) AS covbases, sum(meandepth) AS meandepth
       FROM genome_batches GROUP BY 1, 2, 3, 4""",
)
def coverage_merge(v):
    batches = v.genome_batches
    parts = [batches.filter("file = 'b0'").drop("file"), batches.filter("file <> 'b0'").drop("file")]
    return cv.coverage_merge(parts, ["sample_id", "chrom", "start_pos", "end_pos"], ["numreads", "covbases", "meandepth"])


LAST_TS = 1700000000000 + 60000 * 11


@query(
    "JN15_cumulative_reads",
    f"""SELECT t.sample_id, t.chrom, t.name, t.length, coalesce(n.reads, 0) + coalesce(o.reads, 0) AS reads, (coalesce(n.reads, 0) + coalesce(o.reads, 0)) / t.length AS reads_per_length
        FROM target_coverage t LEFT JOIN (SELECT * FROM target_batches WHERE ts = {LAST_TS}) n USING (sample_id, chrom, start_pos, end_pos, name)
        LEFT JOIN (SELECT sample_id, chrom, start_pos, end_pos, name, CAST(sum(reads) AS BIGINT) AS reads FROM target_batches WHERE ts < {LAST_TS} GROUP BY 1, 2, 3, 4, 5) o USING (sample_id, chrom, start_pos, end_pos, name)""",
)
def cumulative_reads(v):
    batches = v.target_batches
    old = batches.filter(F.col("ts") < LAST_TS).groupBy(*cv.TARGET).agg(F.sum("reads").alias("reads"))
    out = cv.cumulative_reads(v.target_coverage, batches.filter(F.col("ts") == LAST_TS), old)
    return out.select("sample_id", "chrom", "name", "length", "reads", "reads_per_length")


HISTORY = """history AS (SELECT sample_id, chrom, start_pos, end_pos, name, ts, end_pos - start_pos + 1 AS length,
  CAST(sum(bases) OVER w AS BIGINT) AS bases, CAST(sum(reads) OVER w AS BIGINT) AS reads, sum(bases) OVER w / (end_pos - start_pos + 1) AS coverage,
  sum(reads) OVER w / (end_pos - start_pos + 1) AS reads_per_length FROM target_batches
  WINDOW w AS (PARTITION BY sample_id, chrom, start_pos, end_pos, name ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


@query("WIN9_coverage_over_time", f"WITH {HISTORY} SELECT * FROM history")
def coverage_over_time(v):
    return cv.coverage_over_time(v.target_batches)


MARKED = """marked AS (SELECT h.*, CASE WHEN n >= 3 AND sd > 0 AND coverage > m + 2 * sd THEN 'high' WHEN n >= 3 AND sd > 0 AND coverage < m - 2 * sd THEN 'low' ELSE '' END AS outlier
  FROM history h JOIN (SELECT sample_id, ts, count(*) AS n, avg(coverage) AS m, stddev_samp(coverage) AS sd FROM history GROUP BY 1, 2) s USING (sample_id, ts))"""


@query("WIN10_population_outliers", f"WITH {HISTORY}, {MARKED} SELECT sample_id, chrom, start_pos, name, ts, coverage, outlier FROM marked WHERE outlier <> ''")
def population_outliers(v):
    rows = cv.population_outliers(cv.coverage_over_time(v.target_batches), ["sample_id", "ts"])
    return rows.filter("outlier <> ''").select("sample_id", "chrom", "start_pos", "name", "ts", "coverage", "outlier")


@query(
    "SRT3_top_k_outlier_targets",
    f"""WITH {HISTORY}, {MARKED}, per AS (SELECT sample_id, chrom, start_pos, end_pos, name, max(coverage) AS max_coverage, count(*) AS points FROM marked GROUP BY 1, 2, 3, 4, 5 HAVING bool_or(outlier <> '')),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY max_coverage DESC, chrom, start_pos, name) AS rank FROM per)
        SELECT *, printf('%s (%s %.2f Mb)', name, chrom, start_pos / 1000000.0E0) AS label FROM ranked WHERE rank <= 10 AND points >= 2""",
)
def top_outlier_targets(v):
    return cv.outlier_targets(cv.coverage_over_time(v.target_batches))


@query(
    "WIN11_table_outliers",
    """WITH r AS (SELECT sample_id, chrom, name, round(coverage, 2) AS coverage FROM target_coverage), s AS (SELECT sample_id, count(*) AS n, avg(coverage) AS m, stddev_samp(coverage) AS sd FROM r GROUP BY 1)
       SELECT sample_id, chrom, name, coverage, CASE WHEN n >= 3 AND sd > 0 AND coverage > m + 2 * sd THEN 'high' WHEN n >= 3 AND sd > 0 AND coverage < m - 2 * sd THEN 'low' ELSE '' END AS outlier
       FROM r JOIN s USING (sample_id)""",
)
def table_outliers(v):
    rows = v.target_coverage.select("sample_id", "chrom", "name", F.round("coverage", 2).alias("coverage"))
    return cv.population_outliers(rows, ["sample_id"])


def _iqr(keys, k, min_rows):
    return f"""WITH q AS (SELECT {keys}, count(*) AS n, quantile_cont(coverage, 0.25) AS q1, quantile_cont(coverage, 0.75) AS q3 FROM target_coverage GROUP BY {keys})
      SELECT sample_id, chrom, name, coverage, q1, q3, CASE WHEN n < {min_rows} THEN '' WHEN coverage > q3 + {k} * (q3 - q1) THEN 'Gain' WHEN coverage < q1 - {k} * (q3 - q1) THEN 'Loss' ELSE '' END AS outlier
      FROM target_coverage JOIN q USING ({keys})"""


@query("WIN12_iqr_outliers", _iqr("sample_id, chrom", "1.5E0", 4))
def iqr_outliers(v):
    return cv.iqr_outliers(v.target_coverage, ["sample_id", "chrom"]).select("sample_id", "chrom", "name", "coverage", "q1", "q3", "outlier")


@query("WIN12_iqr_outliers_all_rows", _iqr("sample_id", "1.0E0", 1))
def iqr_outliers_all(v):
    return cv.iqr_outliers(v.target_coverage, ["sample_id"], k=1.0, min_rows=1).select("sample_id", "chrom", "name", "coverage", "q1", "q3", "outlier")


@query(
    "WIN13_boxplot_stats",
    f"""SELECT sample_id, chrom, {NATURAL} AS chrom_rank, min(coverage) AS min, quantile_cont(coverage, 0.25) AS q1, quantile_cont(coverage, 0.5) AS median,
        quantile_cont(coverage, 0.75) AS q3, max(coverage) AS max FROM target_coverage GROUP BY 1, 2, 3""",
)
def boxplot_stats(v):
    return cv.boxplot_stats(v.target_coverage)


SUMMARY = """g AS (SELECT sample_id, sum(covbases) / sum(end_pos) AS global_coverage FROM genome_cov GROUP BY 1), t AS (SELECT sample_id, sum(bases) / sum(length) AS target_coverage FROM target_coverage GROUP BY 1)"""


@query(
    "AGG15_coverage_summary",
    f"""WITH {SWEEP}, g AS (SELECT sample_id, sum(covbases) / sum(end_pos) AS global_coverage FROM genome_cov GROUP BY 1), t AS (SELECT sample_id, sum(bases) / sum(length) AS tc FROM target_coverage GROUP BY 1)
        SELECT sample_id, global_coverage, tc AS target_coverage, CASE WHEN global_coverage > 0 THEN tc / global_coverage ELSE 0 END AS enrichment,
        CASE WHEN tc >= 30 THEN 'Excellent' WHEN tc >= 20 THEN 'Good' WHEN tc >= 10 THEN 'Moderate' ELSE 'Insufficient' END AS quality FROM g JOIN t USING (sample_id)""",
)
def coverage_summary(v):
    return cv.coverage_summary(cv.genome_coverage(v.alignments, v.genome), v.target_coverage)


@query(
    "AGG16_coverage_distribution",
    """SELECT sample_id, avg(coverage) AS mean, min(coverage) AS min, max(coverage) AS max, 100.0 * avg(CASE WHEN coverage >= 30 THEN 1.0E0 ELSE 0 END) AS pct_30x,
       100.0 * avg(CASE WHEN coverage >= 20 THEN 1.0E0 ELSE 0 END) AS pct_20x, 100.0 * avg(CASE WHEN coverage >= 10 THEN 1.0E0 ELSE 0 END) AS pct_10x, quantile_cont(coverage, 0.5) AS median
       FROM target_coverage GROUP BY 1""",
)
def coverage_distribution(v):
    return cv.coverage_distribution(v.target_coverage)


@query(
    "AGG17_on_off_target_depth",
    f"""SELECT g.sample_id, g.chrom, {NATURAL.replace('chrom', 'g.chrom')} AS chrom_rank, g.off_target, coalesce(t.on_target, 0) AS on_target
        FROM (SELECT sample_id, chrom, avg(meandepth) AS off_target FROM genome_batches WHERE chrom <> 'chrM' GROUP BY 1, 2) g
        LEFT JOIN (SELECT sample_id, chrom, sum(bases) / sum(length) AS on_target FROM target_coverage GROUP BY 1, 2) t ON g.sample_id = t.sample_id AND g.chrom = t.chrom""",
)
def on_off_target_depth(v):
    return cv.on_off_target_depth(v.genome_batches, v.target_coverage)


@query(
    "AGG18_target_significance",
    """SELECT sample_id, count(*) AS total_targets, count(*) FILTER (bases > 0.5 * mb) AS significant_targets, avg(bases) AS average_score
       FROM target_coverage JOIN (SELECT sample_id, max(bases) AS mb FROM target_coverage GROUP BY 1) m USING (sample_id) GROUP BY 1""",
)
def target_significance(v):
    return cv.significance_summary(cv.target_significance(v.target_coverage))
