"""Streams over tables that Spark derives from the given ones.

The derived table is written once below the shared folder as a few files, and
read back as a stream of several micro-batches.
"""

import math

from pyspark.sql import functions as F

from strandline.operators import coverage as cv
from strandline.operators import qc
from strandline.plans.cnv_queries import TRACK
from strandline.plans.coverage_queries import OVERLAP
from strandline.plans.fusion_queries import PLACES, TAGS
from strandline.plans.registry import query
from strandline.session import scratch_path
from strandline.streaming import pipelines as st


#: Rows of a file above which there are more files in a batch.
FILE_ROWS = 500_000


def file_factor(df, files) -> int:
    """How many times as many files keep each at about ``FILE_ROWS`` rows, so that no task writes a fixed share of the table."""
    return max(1, math.ceil(df.count() / (files * FILE_ROWS)))


def arriving(v, df, key=None, files=4, per_batch=2):
    """The rows of ``df`` as a stream over ``files`` files, or a multiple of both where the rows are many.

    A ``key``, a column or its name, stays in one file; without one all keys are in all batches. The number of batches doesn't depend on the rows:
    where keys leave files out, a batch takes its share of those written.
    """
    path = scratch_path(v.spark, "arriving")
    more = file_factor(df, files)
    (df.repartition(files * more) if key is None else df.repartition(files * more, key)).write.parquet(path)
    written = v.spark.read.parquet(path)
    share = max(1, math.ceil(len(written.inputFiles()) * per_batch / files))
    return st.stream_alignments(v.spark, path, written.schema, share, include="*.parquet")


#: What the streams of fusions read of an alignment; the files that stand for arriving ones hold no more.
FUSION = ["sample_id", "read_id", "chrom", "ref_start", "ref_end", "mapq", "strand", "read_start", "read_end", "is_unmapped", "is_secondary", "is_supplementary", "sa", "qs"]


def arriving_alignments(v):
    """All alignments in 20 batches, dealt by their place, so that most reads have rows in several; no row is sorted for it."""
    return arriving(v, v.alignments.select(*FUSION), F.xxhash64("read_id", "chrom", "ref_start", "ref_end"), files=20, per_batch=1)


def places(v, name):
    return scratch_path(v.spark, name), scratch_path(v.spark, f"{name}-checkpoint")


@query("SRC14_stream_alignments", "SELECT sample_id, file, count(*) AS n FROM alignments GROUP BY 1, 2")
def stream_alignments(v):
    out, ck = places(v, "rows")
    st.drain(arriving(v, v.alignments), lambda df, n: st.put(df.groupBy("sample_id", "file").agg(F.count(F.lit(1)).alias("n")), out, n), ck)
    return v.spark.read.parquet(out).groupBy("sample_id", "file").agg(F.sum("n").alias("n"))


@query("STM1_micro_batches", "SELECT CAST(count(*) AS BIGINT) AS rows, 2 AS batches FROM alignments")
def micro_batches(v):
    out, ck = places(v, "batches")
    st.drain(arriving(v, v.alignments, "file"), lambda df, n: st.put(df.select("read_id"), out, n), ck)
    sizes = v.spark.read.parquet(out).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("batches"))


@query(
    "STM2_stream_qc",
    """SELECT sample_id, count(*) FILTER (NOT is_secondary AND NOT is_unmapped) AS mapped_reads, count(*) FILTER (NOT is_secondary AND is_unmapped) AS unmapped_reads,
       CAST(sum(CASE WHEN NOT is_secondary THEN query_length ELSE 0 END) AS BIGINT) AS bases, count(*) FILTER (is_supplementary) AS supplementary_rows FROM alignments GROUP BY 1""",
)
def stream_qc(v):
    return st.stream_qc(arriving(v, v.alignments), *places(v, "qc"))


@query(
    "STM3_stream_coverage",
    f"""SELECT a.sample_id, g.chrom, g.start_pos, g.end_pos, g.target_id AS name, CAST(sum(least(a.ref_end, g.end_pos) - greatest(a.ref_start, g.start_pos)) AS BIGINT) AS bases
        FROM regions g JOIN alignments a ON {OVERLAP.format(n=0)} AND NOT a.is_unmapped AND NOT a.is_secondary GROUP BY 1, 2, 3, 4, 5""",
)
def stream_coverage(v):
    panel = v.regions.select("chrom", "start_pos", "end_pos", F.col("target_id").alias("name"))
    parts = st.stream_coverage(arriving(v, v.alignments), panel, *places(v, "coverage"))
    return cv.coverage_merge([parts], cv.TARGET, ["bases"])


@query(
    "STM3_coverage_timeline",
    f"""WITH parts AS (SELECT a.sample_id, g.chrom, g.start_pos, g.end_pos, g.target_id AS name, a.ref_start % 4 AS batch_id, CAST(sum(least(a.ref_end, g.end_pos) - greatest(a.ref_start, g.start_pos)) AS BIGINT) AS bases
          FROM regions g JOIN alignments a ON {OVERLAP.format(n=0)} AND NOT a.is_unmapped AND NOT a.is_secondary GROUP BY 1, 2, 3, 4, 5, 6),
        stamps AS (SELECT sample_id, ref_start % 4 AS batch_id, max(st) AS ts FROM alignments GROUP BY 1, 2),
        sums AS (SELECT *, CAST(sum(bases) OVER (PARTITION BY sample_id, chrom, start_pos, end_pos, name ORDER BY batch_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM parts)
        SELECT sample_id, chrom, start_pos, end_pos, name, batch_id, ts, bases, total, total / (end_pos - start_pos + 1) AS coverage FROM sums JOIN stamps USING (sample_id, batch_id)""",
)
def coverage_timeline(v):
    """Four batches, by the remainder of the start."""
    path = scratch_path(v.spark, "quarters")
    files = file_factor(v.alignments, 4)
    for n in range(4):
        # Dealt in turn, so that each quarter has the same number of files, which are its batch.
        v.alignments.filter(f"ref_start % 4 = {n}").repartition(files).write.parquet(f"{path}/n{n}")
    panel = v.regions.select("chrom", "start_pos", "end_pos", F.col("target_id").alias("name"))
    stream = st.stream_alignments(v.spark, path, v.spark.read.parquet(f"{path}/n0").schema, files)
    return st.coverage_timeline(st.stream_coverage(stream, panel, *places(v, "timeline"))).withColumn("batch_id", F.col("batch_id").cast("bigint"))


@query("STM4_files_per_sample", "SELECT sample_id, count(DISTINCT file) AS files FROM meth_rows GROUP BY 1")
def files_per_sample(v):
    out, ck = places(v, "methylation-files")
    st.stream_methylation(arriving(v, v.meth_rows), out, ck)
    return st.files_per_sample(v.spark, out)


@query(
    "STM4_stream_methylation",
    "SELECT sample_id, chrom, pos, CAST(sum(valid_cov) AS BIGINT) AS valid_cov, CAST(sum(n_mod) AS BIGINT) AS n_mod, CAST(sum(n_canonical) AS BIGINT) AS n_canonical FROM meth_rows GROUP BY 1, 2, 3",
)
def stream_methylation(v):
    return st.stream_methylation(arriving(v, v.meth_rows), *places(v, "methylation"))


@query("STM5_stream_cnv", f"WITH {TRACK} SELECT * FROM raw_track")
def stream_cnv(v):
    return st.stream_cnv(arriving(v, v.cnv_starts), *places(v, "cnv"))


@query("STM6_stream_fusion_tags", f"WITH {TAGS} SELECT DISTINCT sample_id, read_id, tag FROM good")
def stream_fusion_tags(v):
    """In 20 batches, so that most reads have rows in several."""
    return st.stream_fusion_tags(arriving_alignments(v), v.regions, *places(v, "tags"))


@query(
    "STM7_stream_breakpoint_clusters",
    f"""WITH {PLACES}, x AS (SELECT sample_id, read_id, struct_pack(chrom := p_chrom, pos := (p_start + p_end) // 2 // 500 * 500, strand := p_strand) AS a, struct_pack(chrom := s_chrom, pos := (s_start + s_end) // 2 // 500 * 500, strand := s_strand) AS b FROM bp),
        o AS (SELECT sample_id, read_id, least(a, b) AS a, greatest(a, b) AS b FROM x)
        SELECT sample_id, a.chrom AS p_chrom, a.pos AS p_start, a.strand AS p_strand, b.chrom AS s_chrom, b.pos AS s_start, b.strand AS s_strand FROM o GROUP BY sample_id, a, b HAVING count(DISTINCT read_id) >= 3""",
)
def stream_breakpoint_clusters(v):
    """In 20 batches; the ends of a read pair up whichever batch they come in."""
    out = st.stream_breakpoint_clusters(arriving_alignments(v), v.regions, *places(v, "clusters"))
    return out.drop("batch_id", "reads")


@query("STM8_stage_and_accumulate", "SELECT sample_id, count(*) AS rows FROM meth_rows GROUP BY 1")
def stage_and_accumulate(v):
    folded = st.stage_and_accumulate(arriving(v, v.meth_rows, files=12, per_batch=1), *places(v, "staged"), limit=10)
    return folded.groupBy("sample_id").agg(F.count(F.lit(1)).alias("rows"))


@query("STM9_idempotent_files", "SELECT DISTINCT sample_id, file FROM alignments")
def idempotent_files(v):
    return st.idempotent_files(arriving(v, v.alignments), *places(v, "files"))


@query(
    "STM9_changed_files",
    """WITH files AS (SELECT sample_id, file AS path, count(*) AS size FROM alignments GROUP BY 1, 2)
       SELECT sample_id, path, size, 1 AS modified FROM files UNION ALL SELECT sample_id, path, size + 7, 2 FROM files WHERE size % 3 = 0""",
)
def changed_files(v):
    """The listing comes three times: as it is, unchanged, and with every third file rewritten under its name."""
    files = v.alignments.groupBy("sample_id", F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("size")).withColumn("modified", F.lit(1))
    third = F.col("size") % 3 == 0
    again = files.withColumns({"size": F.when(third, F.col("size") + 7).otherwise(F.col("size")), "modified": F.when(third, 2).otherwise(1)})
    path = scratch_path(v.spark, "listing")
    for n, part in enumerate((files, files, again)):
        part.coalesce(1).write.parquet(f"{path}/n{n}")
    listing = st.stream_alignments(v.spark, path, files.schema, 1)
    return st.changed_files(listing, *places(v, "fingerprints")).drop("fingerprint")


@query(
    "STM1_batch_plan",
    """WITH arrivals AS (SELECT sample_id, job_type, concat('f', job_id) AS file, job_id * 5 + job_id // 2000 * 5000 AS ts_ms, duration_seconds AS size FROM job_events),
       gaps AS (SELECT *, coalesce(ts_ms - lag(ts_ms) OVER w >= 2000, true)::INT AS opens FROM arrivals WINDOW w AS (PARTITION BY sample_id, job_type ORDER BY ts_ms, file)),
       sessions AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY sample_id, job_type ORDER BY ts_ms, file ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM gaps),
       placed AS (SELECT *, row_number() OVER (PARTITION BY sample_id, job_type, session, size > 300 ORDER BY ts_ms, file) - 1 AS place FROM sessions)
       SELECT sample_id, job_type, file, session, CASE WHEN size > 300 THEN -1 - place ELSE place // CASE job_type WHEN 'cnv' THEN 50 WHEN 'preprocessing' THEN 1 ELSE 20 END END AS batch FROM placed""",
)
def batch_plan(v):
    """Arrivals every 5 ms a job, with a pause of 5 s after each 2,000 jobs; files above 300 are large."""
    ts = F.expr("job_id * 5 + job_id div 2000 * 5000").alias("ts_ms")
    log = v.job_events.select("sample_id", "job_type", F.concat(F.lit("f"), "job_id").alias("file"), ts, F.col("duration_seconds").alias("size"))
    return qc.batch_plan(log, 300)


@query("STM10_score_history", "SELECT sample_id, classifier, batch_id AS run, class_name, score FROM class_scores")
def score_history(v):
    rows = v.class_scores.withColumnRenamed("batch_id", "run")
    return st.score_history(arriving(v, rows, "run"), *places(v, "scores")).drop("batch_id")


@query(
    "SNK8_export_frames",
    """SELECT 'coverage' AS frame, sample_id, chrom, name, CAST(bases AS BIGINT) AS bases FROM target_coverage UNION ALL
       SELECT 'files', sample_id, NULL, file, rows FROM (SELECT sample_id, file, count(*) AS rows FROM alignments GROUP BY 1, 2)""",
)
def export_frames(v):
    """Exports two tables of all samples and reads every row back, by the columns of the manifest."""
    from strandline.sinks.layouts import export_frames as export

    path = scratch_path(v.spark, "export")
    files = v.alignments.groupBy("sample_id", "file").agg(F.count(F.lit(1)).alias("rows"))
    export({"coverage": v.target_coverage.select("sample_id", "chrom", "name", "bases"), "files": files}, path)
    columns = {r["name"]: r["columns"].split(",") for r in v.spark.read.json(f"{path}/manifest").collect()}
    coverage, listed = (v.spark.read.option("header", True).csv(f"{path}/{n}").select(*columns[n]) for n in ("coverage", "files"))
    first = coverage.select(F.lit("coverage").alias("frame"), "sample_id", "chrom", "name", F.col("bases").cast("bigint").alias("bases"))
    return first.unionByName(listed.select(F.lit("files").alias("frame"), "sample_id", F.lit(None).cast("string").alias("chrom"), F.col("file").alias("name"), F.col("rows").cast("bigint").alias("bases")))
