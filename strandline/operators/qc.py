"""Read quality counters per file and per sample, sample ids and job overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed value: the promoter locus of the MGMT gene
MGMT_LOCUS = ("chr10", 129466536, 129467536)
MAX_READS_PER_FILE = 50_000


def sequencing_state(file: Column) -> Column:
    return F.when(F.contains(file, F.lit("pass")), "pass").otherwise("fail")


def submission_fail_only(files: DataFrame, key: str = "sample_id") -> DataFrame:
    """Whether every file name of a submission says fail."""
    return files.groupBy(key).agg(F.bool_and(F.contains(F.lower("file"), F.lit("fail"))).alias("fail_only"))


def barcode_sample_id(rows: DataFrame, read_groups: DataFrame, order: Sequence[str] = ("read_id",)) -> DataFrame:
    """Sample id per file from library or run id, with the barcode of its first barcoded read."""
    number = F.regexp_extract("rg", "_barcode([0-9]{1,2})$", 1).try_cast("int")
    first = (
        rows.withColumn("_n", number)
        .filter(F.col("_n").between(1, 96))
        .groupBy("file")
        .agg(F.min(F.struct(*order, "_n")).alias("b"))
        .select("file", F.concat(F.lit("_barcode"), F.lpad(F.col("b._n").cast("string"), 2, "0")).alias("_code"))
    )
    base = F.coalesce("library", F.nullif("runid", F.lit("")), F.concat(F.lit("unknown_sample_"), "file"))
    out = read_groups.select("file", base.alias("_base")).join(first, "file", "left")
    code = F.when(F.col("_code").isNull() | F.endswith("_base", F.col("_code")), F.lit("")).otherwise(F.col("_code"))
    return out.select("file", F.concat("_base", code).alias("sample_id"))


def file_qc(alignments: DataFrame, run_start: DataFrame | None = None) -> DataFrame:
    """Counters of each file; secondary alignments count only as supplementary evidence."""
    kept = ~F.col("is_secondary")
    mapped, unmapped = kept & ~F.col("is_unmapped"), kept & F.col("is_unmapped")
    length = F.coalesce("query_length", F.lit(0))
    good = sequencing_state(F.col("file")) == "pass"

    def n(cond):
        return F.count_if(cond)

    def bases(cond):
        return F.coalesce(F.sum(F.when(cond, length)), F.lit(0))

    counters = [
        n(mapped).alias("mapped_reads"),
        n(unmapped).alias("unmapped_reads"),
        bases(mapped).alias("mapped_bases"),
        bases(unmapped).alias("unmapped_bases"),
        bases(kept & (length > 0)).alias("yield_bases"),
        n(F.col("is_supplementary")).alias("supplementary_rows"),
        F.max(F.when(kept, F.col("st"))).alias("last_start"),
    ]
    base = alignments.groupBy("sample_id", "file").agg(*counters)
    # one shuffle by (file, read) instead of a distinct set per file
    flagged = alignments.filter(F.col("is_supplementary") | F.col("sa").isNotNull())
    reads = flagged.select("sample_id", "file", "read_id").distinct().groupBy("sample_id", "file").agg(F.count(F.lit(1)).alias("reads_with_supplementary"))
    out = base.join(reads, ["sample_id", "file"], "left").fillna(0, ["reads_with_supplementary"])
    state = F.when(good, "pass").otherwise("fail")
    out = out.withColumn("state", state)
    for what in ("mapped_reads", "unmapped_reads", "mapped_bases", "unmapped_bases"):
        for s in ("pass", "fail"):
            out = out.withColumn(f"{s}_{what}", F.when(F.col("state") == s, F.col(what)).otherwise(0))

    def mean(total, count):
        return F.when(F.col(count) > 0, F.col(total) / F.col(count)).otherwise(0.0)

    out = out.withColumn("mean_mapped_length", mean("mapped_bases", "mapped_reads"))
    out = out.withColumn("mean_unmapped_length", mean("unmapped_bases", "unmapped_reads"))
    if run_start is not None:
        out = out.join(run_start, "file", "left").withColumn("elapsed_seconds", F.expr("timestampdiff(SECOND, run_start, last_start)"))
    return out


def supplementary_read_ids(alignments: DataFrame) -> DataFrame:
    """Distinct reads with supplementary evidence, one row each."""
    rows = alignments.filter(F.col("is_supplementary") | F.col("sa").isNotNull())
    return rows.select("sample_id", "file", "read_id").distinct()


def failing_reads(alignments: DataFrame, minimum: float = 12.0) -> DataFrame:
    """Reads whose primary is below ``minimum``; no value passes."""
    return alignments.filter(failing_rule(minimum)).select("sample_id", "read_id").distinct()


def failing_rule(minimum: float = 12.0) -> Column:
    return ~F.col("is_secondary") & ~F.col("is_supplementary") & (F.col("qs") < minimum)


def qs_filter(alignments: DataFrame, minimum: float = 12.0) -> DataFrame:
    """Drops all alignments of failing reads."""
    return alignments.join(failing_reads(alignments, minimum), ["sample_id", "read_id"], "left_anti")


def file_size_gate(qc: DataFrame, limit: int = MAX_READS_PER_FILE) -> DataFrame:
    """Status and warning class of each file. A file above ``limit`` reads is named as large, never left out."""
    total = F.col("mapped_reads") + F.col("unmapped_reads")
    warning = (
        F.when(total == 0, "empty")
        .when(F.col("mapped_reads") == 0, "no_alignments")
        .when((total > 100) & (100.0 * F.col("mapped_reads") / total < 1.0), "few_alignments")
        .when(total > limit, "large")
        .otherwise("none")
    )
    return qc.select("sample_id", "file", total.alias("total_reads"), F.lit("ok").alias("status"), warning.alias("warning"))


def mgmt_locus_flag(alignments: DataFrame) -> DataFrame:
    """Non-secondary alignments over the promoter locus, per file."""
    chrom, start, end = MGMT_LOCUS
    hit = ~F.col("is_secondary") & ~F.col("is_unmapped") & (F.col("chrom") == chrom) & (F.col("ref_start") < end) & (F.col("ref_end") > start)
    return alignments.groupBy("sample_id", "file").agg(F.bool_or(hit).alias("has_mgmt_reads"), F.count_if(hit).alias("mgmt_read_count"))


def arrival_list(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Distinct values in order of first arrival joined with commas, and the latest value.

    Values are reduced to one row each before the list is built.
    """
    known = rows.filter(F.col(value).isNotNull() & (F.col(value) != ""))
    at = F.struct(*order)
    per_value = known.groupBy(*keys, value).agg(F.min(at).alias("a"), F.max(at).alias("z"))
    return per_value.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", value))), lambda x: x[value]), ",").alias(f"{value}s"),
        F.max_by(value, "z").alias(f"latest_{value}"),
    )


def sample_master(qc: DataFrame, run_info: DataFrame, order: Sequence[str] = ("time_of_run", "file")) -> DataFrame:
    """Running totals of the file counters per sample plus the run facts seen so far."""
    sums = [f"{s}{w}" for s in ("", "pass_", "fail_") for w in ("mapped_reads", "unmapped_reads", "mapped_bases", "unmapped_bases")]
    out = qc.groupBy("sample_id").agg(
        F.count_if(F.col("state") == "pass").alias("files_passed"),
        F.count_if(F.col("state") == "fail").alias("files_failed"),
        F.count(F.lit(1)).alias("files_total"),
        *[F.sum(c).alias(c) for c in sums],
        F.sum("yield_bases").alias("bases"),
        F.sum(F.when(F.col("state") == "pass", F.col("yield_bases")).otherwise(0)).alias("pass_bases"),
        F.sum(F.when(F.col("state") == "fail", F.col("yield_bases")).otherwise(0)).alias("fail_bases"),
    )
    facts = qc.select("sample_id", "file").join(run_info, "file")
    for value in ("device_position", "basecall_model", "flow_cell_id", "time_of_run"):
        out = out.join(arrival_list(facts, ["sample_id"], value, order), "sample_id", "left")
    return out


def sample_overview(jobs: DataFrame, expected: Sequence[str] = ()) -> DataFrame:
    """Job counts, job types and completeness per sample."""
    status = F.col("status")
    # distinct types come from a small pre-aggregate
    small = jobs.groupBy("sample_id", "job_type").agg(
        F.count_if(status == "active").alias("active"),
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count(F.lit(1)).alias("total"),
        F.max("ts").alias("last_seen"),
    )
    done = F.array_sort(F.collect_set(F.when(F.col("completed") > 0, F.col("job_type"))))
    out = small.groupBy("sample_id").agg(
        *[F.sum(c).alias(f"{c}_jobs") for c in ("active", "pending", "completed", "failed", "total")],
        F.array_join(F.array_sort(F.collect_set("job_type")), ",").alias("job_types"),
        F.max("last_seen").alias("last_seen"),
        done.alias("_done"),
    )
    missing = F.array_except(F.array(*[F.lit(e) for e in expected]), "_done") if expected else F.array()
    return out.withColumn("complete", F.size(missing) == 0).drop("_done")


def lifetime_totals(session: DataFrame, earlier: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Totals of this session added to the stored ones."""
    return session.select("sample_id", *columns).unionByName(earlier.select("sample_id", *columns)).groupBy("sample_id").agg(*[F.sum(c).alias(c) for c in columns])


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key: ``max`` of a struct, combined map-side."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def sample_table_filter(samples: DataFrame, origin: str | None = None, job_type: str | None = None, text: str | None = None) -> DataFrame:
    """Origin equality, exact job type in a comma list, free text in the sample id."""
    out = samples
    if origin:
        out = out.filter(F.col("origin") == origin)
    if job_type:
        out = out.filter(F.array_contains(F.transform(F.split("job_types", ","), F.trim), job_type))
    if text:
        out = out.filter(F.contains(F.lower("sample_id"), F.lit(text.lower())))
    return out


def files_by_time(qc: DataFrame) -> DataFrame:
    return qc.select("sample_id", "file", "last_start").orderBy("last_start", "file")


#: fixed values: files of a batch, by job type, and the idle time in milliseconds that ends one
BATCH_SIZES = {"cnv": 50, "preprocessing": 1}
BATCH_SIZE, IDLE_MS = 20, 2000


def batch_plan(arrivals: DataFrame, large: float, sizes: dict[str, int] | None = None, size: int = BATCH_SIZE, idle_ms: int = IDLE_MS) -> DataFrame:
    """The batch of every arriving file: ``sample_id, job_type, file, session, batch``.

    ``arrivals`` has ``sample_id, job_type, file, ts_ms, size``, one row per file. A session
    of a sample and job type ends where nothing arrives for ``idle_ms``; within it the
    files fill batches in order of arrival. A file above ``large`` is a batch of its
    own, and takes no place in the others, but its arrival keeps the session open.
    Sessions count from 1 in a window per sample and job type, over file rows only;
    batches of a session count from 0, those of large files below -1 downward.
    """
    limit = F.lit(size)
    for job, n in (BATCH_SIZES if sizes is None else sizes).items():
        limit = F.when(F.col("job_type") == job, n).otherwise(limit)
    series = Window.partitionBy("sample_id", "job_type").orderBy("ts_ms", "file")
    opens = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(series) >= idle_ms, F.lit(True))
    rows = arrivals.withColumns({"_opens": opens.cast("bigint"), "_large": F.col("size") > large})
    rows = rows.withColumn("session", F.sum("_opens").over(series.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("sample_id", "job_type", "session", "_large").orderBy("ts_ms", "file")) - 1
    rows = rows.withColumns({"_at": place.cast("bigint"), "_limit": limit.cast("bigint")})
    return rows.select("sample_id", "job_type", "file", "session", F.when(F.col("_large"), -1 - F.col("_at")).otherwise(F.expr("_at div _limit")).alias("batch"))
