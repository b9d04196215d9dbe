"""Readers for text and Parquet inputs.

``parse_*`` works on a DataFrame with a ``value`` column (one line per row) and
keeps its other columns; ``read_*`` opens a path with ``spark.read.text`` (gzip
is transparent) and parses it, so no line ever passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.tags import info_map, query_length, reference_length

TAB = "\t"


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path)


def _others(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c != "value"]


def _field(n: int, sep: str = TAB) -> Column:
    return F.try_element_at(F.split("value", sep), F.lit(n))


def _tag(name: str) -> Column:
    return F.nullif(F.regexp_extract("value", f"\t{name}:[A-Za-z]:([^\t]*)", 1), F.lit(""))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignment rows from SAM text; header lines are dropped."""
    flag = _field(2).try_cast("int")
    start = _field(4).try_cast("bigint") - 1
    cigar = _field(6)

    def bit(n):
        return flag.bitwiseAND(n) != 0

    return lines.filter(~F.col("value").startswith("@")).select(
        *_others(lines),
        _field(1).alias("read_id"),
        _field(3).alias("chrom"),
        start.alias("ref_start"),
        (start + reference_length(cigar)).alias("ref_end"),
        _field(5).try_cast("int").alias("mapq"),
        F.when(bit(16), "-").otherwise("+").alias("strand"),
        bit(4).alias("is_unmapped"),
        bit(256).alias("is_secondary"),
        bit(2048).alias("is_supplementary"),
        query_length(cigar).alias("query_length"),
        cigar.alias("cigar"),
        _tag("SA").alias("sa"),
        _tag("qs").try_cast("double").alias("qs"),
        _tag("RG").alias("rg"),
        _tag("st").alias("st"),
    )


def read_sam(spark, path):
    return parse_sam(spark.read.text(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))


def read_alignments(spark, path):
    """Decoded alignments in Parquet; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(path)


def parse_read_group(headers: DataFrame) -> DataFrame:
    """Fields of the first @RG line; known prefixes are stripped."""
    def tag(name):
        return F.nullif(F.regexp_extract("header", f"\t{name}:([^\t]*)", 1), F.lit(""))

    ds = F.split(tag("DS"), " ")
    return headers.select(
        *[c for c in headers.columns if c != "header"],
        tag("ID").alias("rg_id"),
        tag("DT").alias("time_of_run"),
        F.regexp_replace(F.try_element_at(ds, F.lit(1)), "^runid=", "").alias("runid"),
        F.regexp_replace(F.try_element_at(ds, F.lit(2)), "^basecall_model=", "").alias("basecall_model"),
        tag("LB").alias("library"),
        tag("PL").alias("platform"),
        tag("PM").alias("device_position"),
        tag("PU").alias("flow_cell_id"),
        tag("al").alias("alignment"),
    )


def parse_bed(lines: DataFrame) -> DataFrame:
    """BED3, BED4 or BED6; missing name, score and strand are filled."""
    def filled(n, default, nulls):
        text = _field(n)
        return F.when(text.isNull() | text.isin(*nulls), default).otherwise(text)

    return lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        *_others(lines),
        _field(1).alias("chrom"),
        _field(2).try_cast("bigint").alias("start_pos"),
        _field(3).try_cast("bigint").alias("end_pos"),
        filled(4, ".", ["."]).alias("name"),
        filled(5, "0", ["."]).alias("score"),
        filled(6, ".", ["", "?", "."]).alias("strand"),
    )


def read_bed(spark, path):
    return parse_bed(_lines(spark, path))


def parse_gene_bed(lines: DataFrame) -> DataFrame:
    """BED4; rows with fewer fields or bad numbers are dropped."""
    rows = lines.select(
        *_others(lines),
        _field(1).alias("chrom"),
        _field(2).try_cast("bigint").alias("start_pos"),
        _field(3).try_cast("bigint").alias("end_pos"),
        _field(4).alias("gene"),
    )
    return rows.filter("start_pos IS NOT NULL AND end_pos IS NOT NULL AND gene IS NOT NULL")


def read_gene_bed(spark, path):
    return parse_gene_bed(_lines(spark, path))


def parse_bedmethyl(lines: DataFrame) -> DataFrame:
    """Whitespace separated 18 columns; only the essential ones are kept."""
    def f(n):
        return _field(n, r"\s+")

    return lines.filter(F.size(F.split("value", r"\s+")) >= 18).select(
        *_others(lines),
        f(1).alias("chrom"),
        f(2).try_cast("bigint").alias("pos"),
        f(4).alias("mod_code"),
        f(6).alias("strand"),
        f(10).try_cast("bigint").alias("valid_cov"),
        f(11).try_cast("double").alias("percent_modified"),
        f(12).try_cast("bigint").alias("n_mod"),
        f(13).try_cast("bigint").alias("n_canonical"),
    )


def read_bedmethyl(spark, path):
    return parse_bedmethyl(_lines(spark, path))


#: names of the essential methylation columns in the short and the full layout
METH_COLUMNS = {"chrom": "chrom", "chromStart": "pos", "mod_code": "mod_code", "strand": "strand", "percent_modified": "percent_modified"}


def normalise_meth_state(state: DataFrame) -> DataFrame:
    """Essential columns by name, binary text decoded."""
    others = [c for c in state.columns if c in ("sample_id", "file")]
    cols = []
    for source, name in METH_COLUMNS.items():
        col = F.col(source if source in state.columns else name)
        if name in ("chrom", "mod_code", "strand"):
            col = col.cast("string")
        cols.append(col.cast("bigint").alias(name) if name == "pos" else col.alias(name))
    return state.select(*others, *cols)


def read_meth_state(spark, path):
    return normalise_meth_state(spark.read.option("mergeSchema", "true").parquet(path))


def parse_cpg_filter(lines: DataFrame, one_based: bool = False) -> DataFrame:
    """CpG list: headerless 0-based BED, or text with a header and 1-based starts."""
    def f(n):
        return _field(n, r"\s+")

    start = f(2).try_cast("bigint")
    return lines.select(
        *_others(lines), f(1).alias("chrom"), (start - (1 if one_based else 0)).alias("start_pos"), f(3).try_cast("bigint").alias("end_pos"), f(4).alias("label")
    ).filter("start_pos IS NOT NULL AND end_pos IS NOT NULL")


def read_cpg_filter(spark, path):
    return parse_cpg_filter(_lines(spark, path), one_based=str(path).endswith(".txt"))


def parse_probes(lines: DataFrame) -> DataFrame:
    """Whitespace table ``chr start end ID_REF`` with a header line."""
    def f(n):
        return _field(n, r"\s+")

    return lines.filter(f(2).try_cast("bigint").isNotNull()).select(
        *_others(lines), F.regexp_replace(f(1), "^chr", "").alias("chrom"), f(2).try_cast("bigint").alias("start_pos"), f(3).try_cast("bigint").alias("end_pos"), f(4).alias("probe_name")
    )


def read_probes(spark, path):
    return parse_probes(_lines(spark, path))


VCF_COLUMNS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "gt"]


def parse_vcf(lines: DataFrame) -> DataFrame:
    """Ten columns; header rows go by their first field, so INFO may hold ``#``."""
    cols = [_field(i + 1).try_cast({"pos": "bigint", "qual": "double"}.get(n, "string")).alias(n) for i, n in enumerate(VCF_COLUMNS)]
    return lines.filter(~F.col("value").startswith("#")).select(*_others(lines), *cols)


def read_vcf(spark, path):
    return parse_vcf(_lines(spark, path))


def parse_clinvar(lines: DataFrame) -> DataFrame:
    """Variant lines with INFO as a map; only records whose significance is pathogenic."""
    rows = lines.filter(~F.col("value").startswith("#") & (F.size(F.split("value", TAB)) >= 8)).select(
        *_others(lines), _field(1).alias("chrom"), _field(2).try_cast("bigint").alias("pos"), _field(4).alias("ref"), _field(5).alias("alt"), info_map(_field(8)).alias("info")
    )
    significance = F.upper(F.coalesce(F.col("info")["CLNSIG"], F.col("info")["ONC"], F.lit("")))
    return rows.filter(F.contains(significance, F.lit("PATHOGENIC")))


def read_clinvar(spark, path):
    return parse_clinvar(_lines(spark, path))


def parse_cytobands(lines: DataFrame) -> DataFrame:
    return lines.select(*_others(lines), _field(1).alias("chrom"), _field(2).try_cast("bigint").alias("start_pos"), _field(3).try_cast("bigint").alias("end_pos"), _field(4).alias("band"), _field(5).alias("stain")).filter("start_pos IS NOT NULL")


def read_cytobands(spark, path):
    return parse_cytobands(_lines(spark, path))


def parse_centromeres(lines: DataFrame) -> DataFrame:
    return lines.select(*_others(lines), _field(1).alias("chrom"), _field(2).try_cast("bigint").alias("start_pos"), _field(3).try_cast("bigint").alias("end_pos"), _field(4).alias("name")).filter("start_pos IS NOT NULL")


def read_centromeres(spark, path):
    return parse_centromeres(_lines(spark, path))


def parse_fai(lines: DataFrame) -> DataFrame:
    return lines.select(*_others(lines), _field(1).alias("chrom"), _field(2).try_cast("bigint").alias("length")).filter("length IS NOT NULL")


def read_fai(spark, path):
    return parse_fai(_lines(spark, path))


def unpivot_scores(wide: DataFrame, mode: str = "percent", keys=("sample_id", "ts")) -> DataFrame:
    """Class columns to rows; ``fraction`` scores are turned into percent; two decimals."""
    classes = [c for c in wide.columns if c not in keys and c != "number_probes"]
    numeric = wide.select(*keys, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in classes])
    long = numeric.unpivot(list(keys), classes, "class_name", "score").filter("score IS NOT NULL")
    factor = 100.0 if mode == "fraction" else 1.0
    return long.withColumn("score", F.round(F.col("score") * factor, 2))


def read_scores(spark, path, mode="percent"):
    return unpivot_scores(spark.read.csv(path, header=True), mode)


#: three levels of groups, the scores at the lowest
SCORE_REPORT = "sample_id string, members array<struct<group:string,members:array<struct<group:string,members:array<struct<group:string,score:double>>>>>>"


def parse_score_reports(lines: DataFrame) -> DataFrame:
    """JSON reports of nested class groups, one per line; lines that aren't JSON are dropped."""
    return lines.select(F.from_json("value", SCORE_REPORT).alias("r")).select("r.*").filter("members IS NOT NULL")


def read_score_reports(spark, path):
    return parse_score_reports(_lines(spark, path))


def clean_job_durations(log: DataFrame) -> DataFrame:
    """Typed job log; rows without a time or duration, or unfinished ones, are dropped."""
    rows = log.withColumn("duration_seconds", F.expr("try_cast(duration_seconds AS double)")).withColumn("ts", F.expr("try_cast(timestamp_iso AS timestamp_ntz)"))
    done = F.coalesce(F.col("status"), F.lit("")).isin("completed", "skipped", "")
    return rows.filter(F.col("ts").isNotNull() & F.col("duration_seconds").isNotNull() & done)


def read_job_durations(spark, path):
    return clean_job_durations(spark.read.csv(path, header=True))


def validate_bed(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Errors of each line of a region file; all are reported, or the first ``limit`` of them.

    Lines come in text order of their number where a ``line`` column exists.
    """
    start, end = _field(2).try_cast("bigint"), _field(3).try_cast("bigint")
    n = F.size(F.split("value", TAB))
    few = n < 3
    checks = [
        (few, "fewer than 3 fields"),
        (~few & ~_field(1).startswith("chr"), "chromosome without chr"),
        (~few & (start.isNull() | end.isNull()), "position is no integer"),
        ((start < 0) | (end < 0), "negative position"),
        (start >= end, "start not below end"),
        (~few & ((n < 4) | (F.trim(_field(4)) == "")), "missing gene"),
        ((n >= 5) & (_field(5) != ".") & _field(5).try_cast("double").isNull(), "bad score"),
        ((n >= 6) & ~_field(6).isin("+", "-", "."), "bad strand"),
    ]
    errors = F.array_compact(F.array(*[F.when(cond, message) for cond, message in checks]))
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(*_others(lines), "value", F.array_join(errors, "; ").alias("errors")).filter("errors <> ''")
    if limit is None:
        return rows
    return rows.orderBy(*(["line"] if "line" in rows.columns else ["value"])).limit(limit)


def read_json_log(spark, path: str) -> DataFrame:
    """Lines of a JSON log whose records change shape: ``value, record`` (a variant) and ``broken`` for lines that are no JSON."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.withColumn("record", F.try_parse_json("value")).withColumn("broken", F.col("record").isNull())


def log_proportions(log: DataFrame) -> DataFrame:
    """``sample_id, ts, proportions`` of the records of either shape.

    Newer records hold a map of proportions by type, older ones a single type and its
    proportion. Broken lines and records of neither shape are not among them; ``log_shapes``
    counts those.
    """
    field = lambda path, kind: F.try_variant_get("record", path, kind)
    single = F.when(field("$.type", "string").isNotNull() & field("$.proportion", "double").isNotNull(), F.create_map(field("$.type", "string"), field("$.proportion", "double")))
    rows = log.filter(~F.col("broken")).select(
        field("$.sample_id", "string").alias("sample_id"), field("$.ts", "bigint").alias("ts"), F.coalesce(field("$.proportions", "map<string,double>"), single).alias("proportions")
    )
    return rows.filter("proportions IS NOT NULL")


def log_shapes(log: DataFrame) -> DataFrame:
    """Lines by shape: ``map``, ``single``, ``other`` and ``broken``."""
    field = lambda path, kind: F.try_variant_get("record", path, kind)
    shape = F.when(F.col("broken"), "broken").when(field("$.proportions", "map<string,double>").isNotNull(), "map")
    shape = shape.when(field("$.type", "string").isNotNull() & field("$.proportion", "double").isNotNull(), "single").otherwise("other")
    return log.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("lines"))
