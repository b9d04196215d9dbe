"""Row layouts of the output formats, and writers on top of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: fixed value: the colour of the format, like the column names below
COLOUR = "255,0,0"


def _text(df: DataFrame, columns: Sequence, sep: str = "\t") -> DataFrame:
    return df.select(F.concat_ws(sep, *columns).alias("value"))


def bedmethyl_lines(counts: DataFrame) -> DataFrame:
    """18-column text of sites with modified or canonical calls, in key order."""
    zero = F.lit(0)

    def n(name):
        return F.col(name) if name in counts.columns else zero

    rows = counts.filter("n_mod > 0 OR n_canonical > 0").orderBy("chrom", "pos", "strand", *(["mod_code"] if "mod_code" in counts.columns else []))
    code = F.col("mod_code") if "mod_code" in counts.columns else F.lit("C")
    end = F.col("pos") + 1
    percent = F.format_string("%.2f", F.bround("percent_modified", 2))
    return _text(rows, ["chrom", "pos", end, code, "valid_cov", "strand", "pos", end, F.lit(COLOUR), "valid_cov", percent, "n_mod", "n_canonical",
                        n("n_other_mod"), n("n_delete"), n("n_fail"), n("n_diff"), n("n_nocall")])


def meth_state(counts: DataFrame, code: str | None = None) -> DataFrame:
    """The short state: sites with calls, percent with two decimals."""
    mod = F.lit(code) if code else F.col("mod_code")
    rows = counts.filter("n_mod > 0 OR n_canonical > 0")
    return rows.select("sample_id", "chrom", F.col("pos").alias("chromStart"), mod.alias("mod_code"), "strand", "valid_cov", F.bround("percent_modified", 2).alias("percent_modified"), "n_mod", "n_canonical")


def write_meth_state(counts: DataFrame, path: str, code: str | None = None, mode: str = "overwrite") -> None:
    meth_state(counts, code).write.mode(mode).partitionBy("sample_id").parquet(path)


def bed_lines(regions: DataFrame, columns: int = 6) -> DataFrame:
    """BED3, BED4 or BED6 text of rows that are already sorted."""
    fields = ["chrom", "start_pos", "end_pos", "name", "score", "strand"][:columns]
    return _text(regions, fields)


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder of text parts; order holds across the numbered parts."""
    lines.write.mode(mode).text(path)


#: Parts that one task writes one after the other.
TASK_PARTS = 100


def _part_order() -> list[Column]:
    """Task and number within it of a part, from its name."""
    return [F.regexp_extract("file", pattern, 1).cast("bigint") for pattern in ("^part-([0-9]+)-", "-c([0-9]+)\\.[^-]*$")]


def write_ordered(lines: DataFrame, key: Sequence[Column], path: str, rows_per_part: int = 1_000_000) -> None:
    """Text parts in the order of ``key`` (columns of ``value``) across all parts, with a manifest.

    Tasks get ranges of the sampled keys, as many as ``TASK_PARTS`` parts each or a million lines
    ask for, sort them on their own and begin a new part after ``rows_per_part`` lines. So the sample and the
    tasks, of which the driver hears, follow the lines and not the parts. The manifest has
    the file, rows, offset, and first and last key of each part, taken from what was written.
    """
    tasks = max(1, -(-lines.count() // min(1_000_000, rows_per_part * TASK_PARTS)))
    ordered = lines.repartitionByRange(tasks, *key, "value").sortWithinPartitions(*key, "value")
    ordered.write.option("maxRecordsPerFile", rows_per_part).text(f"{path}/lines")
    written = lines.sparkSession.read.text(f"{path}/lines").select("value", F.col("_metadata.file_name").alias("file"))
    whole = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)])
    per_part = written.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min(whole).alias("first"), F.max(whole).alias("last"))
    before = Window.orderBy(*_part_order()).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    per_part.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).write.parquet(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str, low: Sequence | None = None, high: Sequence | None = None) -> DataFrame:
    """``line`` (from 1) and ``value`` of the parts that can hold keys from ``low`` to ``high``, which may be shorter than the key; others are not opened."""
    manifest = spark.read.parquet(f"{path}/manifest")
    kinds = [f.dataType for f in manifest.schema["first"].dataType.fields]
    start = lambda whole, bound: F.struct(*[F.col(f"{whole}.k{i}") for i in range(len(bound))])
    given = lambda bound: F.struct(*[F.lit(v).cast(kinds[i]).alias(f"k{i}") for i, v in enumerate(bound)])
    if low is not None:
        manifest = manifest.filter(start("last", low) >= given(low))
    if high is not None:
        manifest = manifest.filter(start("first", high) <= given(high))
    if low is None and high is None:
        paths = [f"{path}/lines"]
    else:
        paths = [f"{path}/lines/{p.file}" for p in manifest.select("file").collect()]  # one row per part
    if not paths:
        return spark.createDataFrame([], "line long, value string")
    texts = spark.read.text(paths, wholetext=True)
    split = texts.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n\\z", ""), "\n")).alias("at", "value"))
    return split.join(manifest.select("file", "offset"), "file").select((F.col("offset") + F.col("at") + 1).alias("line"), "value")


def append_candidates(candidates: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Appends a batch below ``candidate_type`` and ``sample_id`` folders.

    With ``batch_id`` a repeated batch replaces itself, so retries add nothing.
    """
    parts = ["candidate_type", "sample_id"]
    if batch_id is None:
        candidates.write.mode("append").partitionBy(*parts).parquet(path)
        return
    candidates.write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/batch_id={batch_id}")


def candidate_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("candidate_type", "sample_id").agg(F.count(F.lit(1)).alias("rows"))


def meth_to_bed18(state: DataFrame) -> DataFrame:
    """Full layout rebuilt from the short one; unknown counts are 0."""
    end = F.col("pos") + 1
    zeros = [F.lit(0).cast("bigint").alias(c) for c in ("n_othermod", "n_delete", "n_fail", "n_diff", "n_nocall")]
    strand = F.when(F.col("strand") == ".", "+").otherwise(F.col("strand"))
    return state.select(
        "chrom", F.col("pos").alias("chromStart"), end.alias("chromEnd"), "mod_code", F.col("percent_modified").alias("score_bed"), strand.alias("strand"),
        F.col("pos").alias("thickStart"), end.alias("thickEnd"), F.lit(COLOUR).alias("color"), "valid_cov", "percent_modified", "n_mod", "n_canonical", *zeros,
    )


def meth_to_rf_input(collapsed: DataFrame, depth: int = 10) -> DataFrame:
    """Eleven columns for the forest classifier at an assumed depth."""
    dot, zero = F.lit("."), F.lit(0).cast("bigint")
    n_mod = F.rint(F.col("fraction") * depth / 100).cast("bigint")
    return collapsed.select(
        F.col("chrom").alias("chr"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), dot.alias("dummy1"), zero.alias("dummy2"), "strand",
        dot.alias("dummy3"), zero.alias("dummy4"), dot.alias("dummy5"), F.lit(depth).cast("bigint").alias("cov"), F.col("fraction").alias("methylation_percent"),
        n_mod.alias("n_mod"), (F.lit(depth).cast("bigint") - n_mod).alias("n_canonical"),
    )


def mixed_delim(lines: DataFrame) -> DataFrame:
    """Columns 10 and 11 of an 18-column line joined with a space in column 10."""
    f = F.split("value", "\t")
    joined = F.concat_ws("\t", F.slice(f, 1, 9), F.concat_ws(" ", f[9], f[10]), F.slice(f, 11, F.greatest(F.size(f) - 10, F.lit(0))))
    return lines.select(F.when(F.size(f) >= 18, joined).otherwise(F.col("value")).alias("value"))


def export_frames(frames: dict[str, DataFrame], path: str, by: str = "sample_id") -> None:
    """Every report table as CSV in a folder per sample, plus a manifest of names and columns."""
    spark = None
    for name, df in frames.items():
        spark = df.sparkSession
        df.write.mode("overwrite").partitionBy(by).option("header", True).csv(f"{path}/{name}")
    if spark is not None:
        manifest = [(name, ",".join(df.columns)) for name, df in frames.items()]
        spark.createDataFrame(manifest, "name string, columns string").write.mode("overwrite").json(f"{path}/manifest")


def merge_vcfs(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of variant tables from several chunks."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_vcf_table(vcf: DataFrame, path: str) -> None:
    vcf.write.mode("overwrite").option("header", True).csv(path)
