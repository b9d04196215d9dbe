"""Read quality, sample ids and job overviews on the given tables."""

from pyspark.sql import functions as F

from strandline.operators import qc
from strandline.operators.intervals import primary_only
from strandline.plans.registry import query
from strandline.sources.text import parse_read_group

RG = r"""rg AS (SELECT file, nullif(regexp_extract(header, '\tDT:([^\t]*)', 1), '') AS time_of_run, nullif(regexp_extract(header, 'runid=([^ \t]*)', 1), '') AS runid,
  nullif(regexp_extract(header, 'basecall_model=([^ \t]*)', 1), '') AS basecall_model, nullif(regexp_extract(header, '\tLB:([^\t]*)', 1), '') AS library,
  nullif(regexp_extract(header, '\tPM:([^\t]*)', 1), '') AS device_position, nullif(regexp_extract(header, '\tPU:([^\t]*)', 1), '') AS flow_cell_id FROM read_groups)"""

_M, _U = "NOT is_secondary AND NOT is_unmapped", "NOT is_secondary AND is_unmapped"
QC = f"""qc AS (SELECT sample_id, file, CASE WHEN contains(file, 'pass') THEN 'pass' ELSE 'fail' END AS state,
  count(*) FILTER ({_M}) AS mapped_reads, count(*) FILTER ({_U}) AS unmapped_reads,
  CAST(coalesce(sum(query_length) FILTER ({_M}), 0) AS BIGINT) AS mapped_bases, CAST(coalesce(sum(query_length) FILTER ({_U}), 0) AS BIGINT) AS unmapped_bases,
  CAST(coalesce(sum(query_length) FILTER (NOT is_secondary), 0) AS BIGINT) AS yield_bases, count(*) FILTER (is_supplementary) AS supplementary_rows,
  max(st) FILTER (NOT is_secondary) AS last_start, count(DISTINCT read_id) FILTER (is_supplementary OR sa IS NOT NULL) AS reads_with_supplementary
  FROM alignments GROUP BY ALL)"""
_SPLIT = ", ".join(
    f"CASE WHEN state = '{s}' THEN {w} ELSE 0 END AS {s}_{w}" for w in ("mapped_reads", "unmapped_reads", "mapped_bases", "unmapped_bases") for s in ("pass", "fail")
)


@query(
    "FLT1_primary_only",
    """SELECT sample_id, count(*) FILTER (NOT is_secondary AND NOT is_supplementary AND NOT is_unmapped) AS primary_rows,
       count(*) FILTER (NOT is_secondary) AS non_secondary_rows FROM alignments GROUP BY 1""",
)
def primary_rows(v):
    rows = v.alignments
    tagged = primary_only(rows).select("sample_id", F.lit("p").alias("kind")).unionByName(rows.filter("NOT is_secondary").select("sample_id", F.lit("n").alias("kind")))
    return tagged.groupBy("sample_id").agg(
        F.count_if(F.col("kind") == "p").alias("primary_rows"), F.count_if(F.col("kind") == "n").alias("non_secondary_rows")
    )


@query(
    "FLT6_sequencing_state",
    """SELECT file, CASE WHEN contains(file, 'pass') THEN 'pass' ELSE 'fail' END AS state, sample_id,
       bool_and(contains(lower(file), 'fail')) OVER (PARTITION BY sample_id) AS fail_only FROM (SELECT DISTINCT sample_id, file FROM alignments)""",
)
def sequencing_state(v):
    files = v.alignments.select("sample_id", "file").distinct()
    return files.join(qc.submission_fail_only(files), "sample_id").select("file", qc.sequencing_state(F.col("file")).alias("state"), "sample_id", "fail_only")


@query(
    "FLT7_barcode_sample_id",
    f"""WITH {RG}, codes AS (SELECT file, read_id, TRY_CAST(nullif(regexp_extract(rg, '_barcode([0-9]{{1,2}})$', 1), '') AS INT) AS n FROM alignments),
        firsts AS (SELECT file, n, row_number() OVER (PARTITION BY file ORDER BY read_id, n) AS k FROM codes WHERE n BETWEEN 1 AND 96),
        named AS (SELECT rg.file, coalesce(library, runid, concat('unknown_sample_', rg.file)) AS base, concat('_barcode', lpad(CAST(n AS VARCHAR), 2, '0')) AS code, n
                  FROM rg LEFT JOIN firsts ON rg.file = firsts.file AND k = 1)
        SELECT file, CASE WHEN n IS NULL OR ends_with(base, code) THEN base ELSE concat(base, code) END AS sample_id FROM named""",
)
def barcode_sample_id(v):
    return qc.barcode_sample_id(v.alignments, parse_read_group(v.read_groups))


@query("AGG1_supplementary_reads", "SELECT DISTINCT sample_id, file, read_id FROM alignments WHERE is_supplementary OR sa IS NOT NULL")
def supplementary_reads(v):
    return qc.supplementary_read_ids(v.alignments)


@query(
    "FLT8_file_size_gate",
    f"""WITH {QC} SELECT sample_id, file, mapped_reads + unmapped_reads AS total_reads, 'ok' AS status,
        CASE WHEN mapped_reads + unmapped_reads = 0 THEN 'empty' WHEN mapped_reads = 0 THEN 'no_alignments'
             WHEN mapped_reads + unmapped_reads > 100 AND 100.0 * mapped_reads / (mapped_reads + unmapped_reads) < 1 THEN 'few_alignments' WHEN mapped_reads + unmapped_reads > 50000 THEN 'large' ELSE 'none' END AS warning FROM qc""",
)
def file_size_gate(v):
    return qc.file_size_gate(qc.file_qc(v.alignments))


FILE_QC_COLUMNS = "sample_id, file, state, mapped_reads, unmapped_reads, mapped_bases, unmapped_bases, yield_bases, supplementary_rows, reads_with_supplementary"


@query(
    "AGG1_file_qc",
    f"""WITH {RG}, {QC} SELECT {FILE_QC_COLUMNS}, {_SPLIT}, CAST(last_start AS VARCHAR) AS last_start,
        CASE WHEN mapped_reads > 0 THEN mapped_bases / mapped_reads ELSE 0.0 END AS mean_mapped_length,
        CASE WHEN unmapped_reads > 0 THEN unmapped_bases / unmapped_reads ELSE 0.0 END AS mean_unmapped_length,
        date_diff('second', CAST(replace(replace(time_of_run, 'T', ' '), 'Z', '') AS TIMESTAMP), last_start) AS elapsed_seconds
        FROM qc LEFT JOIN rg USING (file)""",
)
def file_qc(v):
    clock = F.regexp_replace(F.regexp_replace("time_of_run", "T", " "), "Z", "").cast("timestamp_ntz")
    starts = parse_read_group(v.read_groups).select("file", clock.alias("run_start"))
    out = qc.file_qc(v.alignments, starts)
    return out.withColumn("last_start", F.col("last_start").cast("string")).drop("run_start")


_SUMS = ", ".join(
    [f"CAST(sum({w}) AS BIGINT) AS {w}" for w in ("mapped_reads", "unmapped_reads", "mapped_bases", "unmapped_bases")]
    + [f"CAST(coalesce(sum({w}) FILTER (state = '{s}'), 0) AS BIGINT) AS {s}_{w}" for s in ("pass", "fail") for w in ("mapped_reads", "unmapped_reads", "mapped_bases", "unmapped_bases")]
)
_FACTS = "device_position basecall_model flow_cell_id time_of_run".split()
_LISTS = ", ".join(
    f"""l_{f} AS (SELECT sample_id, string_agg({f}, ',' ORDER BY a) AS {f}s, arg_max({f}, z) AS latest_{f} FROM
    (SELECT sample_id, {f}, min(concat(time_of_run, file)) AS a, max(concat(time_of_run, file)) AS z FROM qc JOIN rg USING (file) WHERE {f} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
    for f in _FACTS
)


@query(
    "AGG2_sample_master",
    f"""WITH {RG}, {QC}, {_LISTS}, t AS (SELECT sample_id, count(*) FILTER (state = 'pass') AS files_passed, count(*) FILTER (state = 'fail') AS files_failed, count(*) AS files_total, {_SUMS},
          CAST(sum(yield_bases) AS BIGINT) AS bases, CAST(coalesce(sum(yield_bases) FILTER (state = 'pass'), 0) AS BIGINT) AS pass_bases,
          CAST(coalesce(sum(yield_bases) FILTER (state = 'fail'), 0) AS BIGINT) AS fail_bases FROM qc GROUP BY 1)
        SELECT * FROM t {' '.join(f'LEFT JOIN l_{f} USING (sample_id)' for f in _FACTS)}""",
)
def sample_master(v):
    return qc.sample_master(qc.file_qc(v.alignments), parse_read_group(v.read_groups))


@query(
    "AGG3_mgmt_locus_flag",
    """SELECT sample_id, file, bool_or(hit) AS has_mgmt_reads, count(*) FILTER (hit) AS mgmt_read_count FROM (
         SELECT sample_id, file, NOT is_secondary AND NOT is_unmapped AND chrom = 'chr10' AND ref_start + 129360000 < 129467536 AND ref_end + 129360000 > 129466536 AS hit FROM alignments) GROUP BY 1, 2""",
)
def mgmt_locus_flag(v):
    moved = v.alignments.withColumns({"ref_start": F.col("ref_start") + 129360000, "ref_end": F.col("ref_end") + 129360000})
    return qc.mgmt_locus_flag(moved)


OVERVIEW = """overview AS (SELECT sample_id, count(*) FILTER (status = 'active') AS active_jobs, count(*) FILTER (status = 'pending') AS pending_jobs,
  count(*) FILTER (status = 'completed') AS completed_jobs, count(*) FILTER (status = 'failed') AS failed_jobs, count(*) AS total_jobs,
  string_agg(DISTINCT job_type, ',' ORDER BY job_type) AS job_types, max(ts) AS last_seen,
  count(DISTINCT job_type) FILTER (status = 'completed' AND job_type IN ('cnv', 'fusion', 'mgmt', 'target')) = 4 AS complete FROM job_events GROUP BY 1)"""


@query("AGG47_sample_overview", f"WITH {OVERVIEW} SELECT * REPLACE (CAST(last_seen AS VARCHAR) AS last_seen) FROM overview")
def sample_overview(v):
    out = qc.sample_overview(v.job_events, ["cnv", "fusion", "mgmt", "target"])
    return out.withColumn("last_seen", F.col("last_seen").cast("string"))


@query(
    "AGG47_lifetime_totals",
    """SELECT sample_id, count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS completed_jobs, count(*) FILTER (status = 'failed') AS failed_jobs FROM job_events GROUP BY 1""",
)
def lifetime_totals(v):
    jobs = v.job_events
    cols = ["total_jobs", "completed_jobs", "failed_jobs"]
    return qc.lifetime_totals(qc.sample_overview(jobs.filter("origin = 'live'")), qc.sample_overview(jobs.filter("origin = 'existing'")), cols)


@query(
    "WIN14_latest_per_key",
    """SELECT sample_id, job_type, job_id, status, origin FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, job_type ORDER BY ts DESC, job_id DESC) AS k FROM job_events) WHERE k = 1""",
)
def latest_per_key(v):
    rows = v.job_events.select("sample_id", "job_type", "ts", "job_id", "status", "origin")
    return qc.latest_per_key(rows, ["sample_id", "job_type"], ["ts", "job_id"]).drop("ts")


@query(
    "FLT14_sample_table_filter",
    f"""WITH {OVERVIEW}, o AS (SELECT sample_id, origin, string_agg(DISTINCT job_type, ',' ORDER BY job_type) AS job_types FROM job_events GROUP BY 1, 2)
        SELECT sample_id, origin, job_types FROM o WHERE origin = 'live' AND list_contains(string_split(job_types, ','), 'cnv') AND contains(sample_id, 's')""",
)
def sample_table_filter(v):
    jobs = v.job_events.select("sample_id", "origin", "job_type").distinct()
    table = jobs.groupBy("sample_id", "origin").agg(F.array_join(F.array_sort(F.collect_list("job_type")), ",").alias("job_types"))
    return qc.sample_table_filter(table, origin="live", job_type="cnv", text="S")


@query("SRT7_files_by_time", f"WITH {QC} SELECT sample_id, file, CAST(last_start AS VARCHAR) AS last_start FROM qc ORDER BY last_start, file")
def files_by_time(v):
    return qc.files_by_time(qc.file_qc(v.alignments)).withColumn("last_start", F.col("last_start").cast("string"))


@query(
    "WIN16_rolling_median",
    """WITH d AS (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY ts, job_id) - 1 AS i, count(*) OVER (PARTITION BY job_type) AS n FROM job_events WHERE status = 'completed'),
         m AS (SELECT a.job_id, count(*) AS c, median(b.duration_seconds) AS md FROM d a JOIN d b ON a.job_type = b.job_type AND b.i <= a.i AND b.i > a.i - greatest(10, a.n // 20) GROUP BY 1)
       SELECT d.sample_id, d.job_id, d.job_type, d.duration_seconds, CASE WHEN c >= 5 THEN md END AS rolling_median FROM d JOIN m USING (job_id) WHERE n >= 10""",
)
def rolling_median(v):
    from strandline.operators.rolling import rolling_median as rolling

    log = v.job_events.filter("status = 'completed'")
    return rolling(log).select("sample_id", "job_id", "job_type", "duration_seconds", "rolling_median")
