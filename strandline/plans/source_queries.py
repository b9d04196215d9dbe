"""Readers, fed with lines that Spark derives from the given tables."""

from pyspark.sql import functions as F

from strandline.functions.tags import aligned_blocks, supplementary_spans
from strandline.plans.registry import query
from strandline.session import scratch_path
from strandline.sources import text as src

SAM_COLUMNS = "sample_id, file, read_id, chrom, ref_start, ref_end, mapq, strand, is_unmapped, is_secondary, is_supplementary, query_length, cigar, sa, qs, rg"


def sam_lines(alignments):
    flag = (
        F.when(F.col("is_unmapped"), 4).otherwise(0)
        + F.when(F.col("strand") == "-", 16).otherwise(0)
        + F.when(F.col("is_secondary"), 256).otherwise(0)
        + F.when(F.col("is_supplementary"), 2048).otherwise(0)
    )
    tags = F.concat(
        F.lit("\tRG:Z:"), "rg", F.lit("\tqs:f:"), F.col("qs").cast("string"), F.lit("\tst:Z:"), F.col("st").cast("string"),
        F.coalesce(F.concat(F.lit("\tSA:Z:"), "sa"), F.lit("")),
    )
    core = F.concat_ws("\t", "read_id", flag, "chrom", F.col("ref_start") + 1, "mapq", "cigar", F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"))
    return alignments.select("sample_id", "file", F.concat(core, tags).alias("value"))


def on_disk(v, lines, name, by=()):
    """Path of a text folder with the lines; ``by`` columns become folders, which readers give back."""
    path = scratch_path(v.spark, name)
    lines.select(*by, "value").write.partitionBy(*by).text(path)
    return path


@query("SRC1_read_alignments", f"SELECT {SAM_COLUMNS}, CAST(st AS VARCHAR) AS st FROM alignments")
def read_alignments(v):
    """SAM text to Parquet, read as alignments."""
    path = scratch_path(v.spark, "alignments")
    src.parse_sam(sam_lines(v.alignments)).write.parquet(path)
    return src.read_alignments(v.spark, path)


@query("SRC1_read_sam", "SELECT read_id, chrom, ref_start, ref_end, mapq, is_unmapped, count(*) AS n FROM alignments GROUP BY ALL")
def read_sam(v):
    rows = src.read_sam(v.spark, on_disk(v, sam_lines(v.alignments), "sam", ["sample_id"]))
    return rows.groupBy("read_id", "chrom", "ref_start", "ref_end", "mapq", "is_unmapped").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SRC2_parse_read_group",
    r"""SELECT file, nullif(regexp_extract(header, '\tID:([^\t]*)', 1), '') AS rg_id, nullif(regexp_extract(header, '\tDT:([^\t]*)', 1), '') AS time_of_run,
        nullif(regexp_extract(header, 'runid=([^ \t]*)', 1), '') AS runid, nullif(regexp_extract(header, 'basecall_model=([^ \t]*)', 1), '') AS basecall_model,
        nullif(regexp_extract(header, '\tLB:([^\t]*)', 1), '') AS library, nullif(regexp_extract(header, '\tPL:([^\t]*)', 1), '') AS platform,
        nullif(regexp_extract(header, '\tPM:([^\t]*)', 1), '') AS device_position, nullif(regexp_extract(header, '\tPU:([^\t]*)', 1), '') AS flow_cell_id,
        nullif(regexp_extract(header, '\tal:([^\t]*)', 1), '') AS alignment FROM read_groups""",
)
def parse_read_group(v):
    return src.parse_read_group(v.read_groups)


BED_LINES = """bed_lines AS (SELECT concat(chrom, chr(9), CAST(start_pos AS STRING), chr(9), CAST(end_pos AS STRING),
  CASE WHEN region_type = 'target' THEN '' WHEN strand = '-' THEN concat(chr(9), name) ELSE concat(chr(9), name, chr(9), '.', chr(9), CASE WHEN strand = '.' THEN '?' ELSE strand END) END) AS value FROM regions
  UNION ALL SELECT concat('#', chrom) AS value FROM genome)"""


@query(
    "SRC3_read_bed",
    """SELECT chrom, start_pos, end_pos, CASE WHEN region_type = 'target' THEN '.' ELSE name END AS name, '0' AS score,
       CASE WHEN region_type = 'target' OR strand = '-' THEN '.' ELSE strand END AS strand FROM regions""",
)
def read_bed(v):
    return src.read_bed(v.spark, on_disk(v, v.sql(f"WITH {BED_LINES} SELECT * FROM bed_lines"), "bed"))


GENE_LINES = """gene_lines AS (SELECT CASE WHEN strand = '-' THEN concat(chrom, chr(9), CAST(start_pos AS STRING)) WHEN strand = '.' THEN concat(chrom, chr(9), 'x', chr(9), CAST(end_pos AS STRING), chr(9), name)
  ELSE concat(chrom, chr(9), CAST(start_pos AS STRING), chr(9), CAST(end_pos AS STRING), chr(9), name) END AS value FROM regions)"""


@query("SRC4_read_gene_bed", "SELECT chrom, start_pos, end_pos, name AS gene FROM regions WHERE strand = '+'")
def read_gene_bed(v):
    return src.read_gene_bed(v.spark, on_disk(v, v.sql(f"WITH {GENE_LINES} SELECT * FROM gene_lines"), "genes"))


def bedmethyl_lines(rows):
    tail = [F.lit(0)] * 5
    pct = F.format_string("%.2f", "percent_modified")
    value = F.concat_ws(
        "\t", "chrom", "pos", F.col("pos") + 1, "mod_code", pct, "strand", "pos", F.col("pos") + 1, F.lit("255,0,0"), F.concat_ws(" ", "valid_cov", pct), "n_mod", "n_canonical", *tail
    )
    return rows.select("sample_id", "file", value.alias("value"))


@query(
    "SRC5_read_bedmethyl",
    "SELECT sample_id, file, chrom, pos, mod_code, strand, valid_cov, round(percent_modified, 2) AS percent_modified, n_mod, n_canonical FROM meth_rows",
)
def read_bedmethyl(v):
    return src.read_bedmethyl(v.spark, on_disk(v, bedmethyl_lines(v.meth_rows), "bedmethyl", ["sample_id", "file"]))


@query("SRC6_read_meth_state", "SELECT sample_id, chrom, pos, mod_code, strand, percent_modified FROM meth_rows")
def read_meth_state(v):
    def enc(c):
        return F.encode(c, "utf-8").alias(c)

    stored = v.meth_rows.select("sample_id", enc("chrom"), F.col("pos").alias("chromStart"), enc("mod_code"), enc("strand"), "valid_cov", "percent_modified", "n_mod", "n_canonical")
    # Half of the rows in the short layout, half in the full one, in one folder.
    path = scratch_path(v.spark, "meth-state")
    stored.filter("chromStart % 2 = 0").write.parquet(path)
    end = F.col("chromStart") + 1
    zeros = {c: F.lit(0).cast("bigint") for c in ("n_othermod", "n_delete", "n_fail", "n_diff", "n_nocall")}
    full = stored.filter("chromStart % 2 <> 0").withColumns({"chromEnd": end, "score_bed": F.col("percent_modified"), "thickStart": F.col("chromStart"), "thickEnd": end, "color": F.lit("255,0,0"), **zeros})
    full.write.mode("append").parquet(path)
    return src.read_meth_state(v.spark, path)


@query(
    "SRC7_read_cpg_filter",
    "SELECT chrom, start_pos, end_pos, probe_name AS label, 'bed' AS layout FROM probes UNION ALL SELECT chrom, start_pos, end_pos, probe_name, 'txt' FROM probes",
)
def read_cpg_filter(v):
    bed = v.probes.select(F.concat_ws("\t", "chrom", "start_pos", "end_pos", "probe_name").alias("value"), F.lit("bed").alias("layout"))
    txt = v.probes.select(F.concat_ws(" ", "chrom", F.col("start_pos") + 1, "end_pos", "probe_name").alias("value"), F.lit("txt").alias("layout"))
    header = v.table("region").select(F.lit("chr start end IlmnID").alias("value"), F.lit("txt").alias("layout"))
    read = [src.read_cpg_filter(v.spark, on_disk(v, rows, "cpg") + "/*.txt" if one else on_disk(v, rows, "cpg")).withColumn("layout", F.lit("txt" if one else "bed")) for rows, one in ((bed, False), (txt.unionByName(header), True))]
    return read[0].unionByName(read[1])


@query("SRC8_read_probes", "SELECT regexp_replace(chrom, '^chr', '') AS chrom, start_pos, end_pos, probe_name FROM probes")
def read_probes(v):
    lines = v.probes.select(F.concat_ws("  ", "chrom", "start_pos", "end_pos", "probe_name").alias("value"))
    return src.read_probes(v.spark, on_disk(v, lines.unionByName(v.table("region").select(F.lit("chr start end ID_REF").alias("value"))), "probes"))


def vcf_lines(vcf):
    line = vcf.select(F.concat_ws("\t", "chrom", "pos", "id", "ref", "alt", "qual", "filter", F.concat("info", F.lit(";NOTE=a#b")), "format", "gt").alias("value"))
    return line.unionByName(vcf.select(F.concat(F.lit("##"), "id").alias("value")))


@query("SRC9_read_vcf", "SELECT chrom, pos, id, ref, alt, qual, filter, concat(info, ';NOTE=a#b') AS info, format, gt FROM vcf")
def read_vcf(v):
    return src.read_vcf(v.spark, on_disk(v, vcf_lines(v.vcf), "vcf"))


@query(
    "SRC10_read_clinvar",
    """SELECT chrom, pos, ref, alt, regexp_extract(info, 'CLNSIG=([^;]*)', 1) AS clnsig, regexp_extract(info, 'GENEINFO=([^;]*)', 1) AS geneinfo
       FROM vcf WHERE contains(upper(regexp_extract(info, 'CLNSIG=([^;]*)', 1)), 'PATHOGENIC')""",
)
def read_clinvar(v):
    rows = src.read_clinvar(v.spark, on_disk(v, vcf_lines(v.vcf), "clinvar"))
    return rows.select("chrom", "pos", "ref", "alt", F.col("info")["CLNSIG"].alias("clnsig"), F.col("info")["GENEINFO"].alias("geneinfo"))


@query(
    "SRC11_reference_tables",
    """SELECT 'band' AS kind, chrom, end_pos - start_pos AS length, band AS name FROM cytobands UNION ALL
       SELECT 'centromere', chrom, end_pos - start_pos, band FROM cytobands WHERE stain = 'acen' UNION ALL SELECT 'fai', chrom, length, NULL FROM genome""",
)
def reference_tables(v):
    bands = src.read_cytobands(v.spark, on_disk(v, v.cytobands.select(F.concat_ws("\t", "chrom", "start_pos", "end_pos", "band", "stain").alias("value")), "bands"))
    cens = src.read_centromeres(v.spark, on_disk(v, v.cytobands.filter("stain = 'acen'").select(F.concat_ws("\t", "chrom", "start_pos", "end_pos", "band").alias("value")), "centromeres"))
    fai = src.read_fai(v.spark, on_disk(v, v.genome.select(F.concat_ws("\t", "chrom", "length", F.lit("6")).alias("value")), "fai"))

    def rows(df, kind, name):
        return df.select(F.lit(kind).alias("kind"), "chrom", (F.col("end_pos") - F.col("start_pos")).alias("length"), F.col(name).alias("name"))

    return rows(bands, "band", "band").unionByName(rows(cens, "centromere", "name")).unionByName(
        fai.select(F.lit("fai").alias("kind"), "chrom", "length", F.lit(None).cast("string").alias("name"))
    )


@query(
    "SRC12_read_scores",
    "SELECT classifier, sample_id, batch_id AS ts, class_name, round(max(score) * 100, 2) AS score FROM class_scores GROUP BY 1, 2, 3, 4",
)
def read_scores(v):
    """One wide CSV per classifier, fractions in one and percent in the other."""
    out = None
    for classifier, mode, factor in (("sturgeon", "fraction", 1.0), ("random_forest", "percent", 100.0)):
        rows = v.class_scores.filter(F.col("classifier") == classifier).groupBy("sample_id", F.col("batch_id").alias("ts"))
        wide = rows.pivot("class_name", [f"class_{i}" for i in range(12)]).agg((F.max("score") * factor).cast("string"))
        path = scratch_path(v.spark, "scores")
        wide.withColumn("number_probes", F.lit("1000")).write.option("header", True).csv(path)
        part = src.read_scores(v.spark, path, mode).select(F.lit(classifier).alias("classifier"), "sample_id", F.col("ts").cast("bigint").alias("ts"), "class_name", "score")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "SRC13_read_job_durations",
    "SELECT sample_id, job_id, job_type, status, duration_seconds, CAST(ts AS VARCHAR) AS ts FROM job_events WHERE status = 'completed' AND job_id % 10 <> 3",
)
def read_job_durations(v):
    bad = F.col("job_id") % 10 == 3
    log = v.job_events.select(
        F.col("ts").cast("string").alias("timestamp_iso"), "sample_id", "job_id", "job_type", "status",
        F.when(bad, "n/a").otherwise(F.col("duration_seconds").cast("string")).alias("duration_seconds"),
    )
    path = scratch_path(v.spark, "durations")
    log.write.option("header", True).csv(path)
    out = src.read_job_durations(v.spark, path)
    return out.select("sample_id", F.col("job_id").cast("bigint").alias("job_id"), "job_type", "status", "duration_seconds", F.col("ts").cast("string").alias("ts"))


SA_SQL = """SELECT sample_id, read_id, ref_start, split_part(e, ',', 1) AS sa_chrom, CAST(split_part(e, ',', 2) AS BIGINT) AS sa_start,
  CAST(split_part(e, ',', 2) AS BIGINT) + CASE WHEN split_part(e, ',', 4) = '*' THEN 100
    ELSE CAST(regexp_extract(split_part(e, ',', 4), '^([0-9]+)M', 1) AS BIGINT) + 50 END AS sa_end,
  split_part(e, ',', 3) AS sa_strand, CAST(split_part(e, ',', 5) AS INT) AS sa_mapq
  FROM (SELECT sample_id, read_id, ref_start, unnest(string_split(sa, ';')) AS e FROM alignments WHERE sa IS NOT NULL) q WHERE e <> '' AND split_part(e, ',', 1) <> 'chrM'"""


@query("STR1_sa_entries", SA_SQL)
def sa_entries(v):
    rows = supplementary_spans(v.alignments.select("sample_id", "read_id", "ref_start", "sa"))
    return rows.drop("sa")


@query(
    "STR2_cigar_blocks",
    """SELECT sample_id, read_id, ref_start AS block_start, ref_start + m AS block_end, CAST(5 AS BIGINT) AS read_offset FROM (
         SELECT *, CAST(regexp_extract(cigar, '5S([0-9]+)M', 1) AS BIGINT) AS m FROM alignments) UNION ALL
       SELECT sample_id, read_id, ref_start + m + 5, ref_end, 5 + m FROM (SELECT *, CAST(regexp_extract(cigar, '5S([0-9]+)M', 1) AS BIGINT) AS m FROM alignments)""",
)
def cigar_blocks(v):
    rows = aligned_blocks(v.alignments.select("sample_id", "read_id", "ref_start", "cigar"))
    return rows.select("sample_id", "read_id", "block_start", "block_end", "read_offset")


CHECK_LINES = """check_lines AS (SELECT target_id, CASE WHEN strand = '+' THEN concat(chrom, chr(9), CAST(start_pos AS STRING), chr(9), CAST(end_pos AS STRING), chr(9), name, chr(9), '0', chr(9), '+')
  WHEN region_type = 'target' THEN concat(replace(chrom, 'chr', ''), chr(9), CAST(end_pos AS STRING), chr(9), CAST(start_pos AS STRING)) WHEN strand = '-' THEN concat(chrom, chr(9), 'x', chr(9), CAST(end_pos AS STRING), chr(9), name)
  ELSE concat(chrom, chr(9), CAST(start_pos AS STRING), chr(9), CAST(end_pos AS STRING), chr(9), name, chr(9), 'low', chr(9), '?') END AS value FROM regions)"""


@query(
    "FLT13_validate_bed",
    """SELECT target_id, CASE WHEN region_type = 'target' THEN 'chromosome without chr; start not below end; missing gene' WHEN strand = '-' THEN 'position is no integer' ELSE 'bad score; bad strand' END AS errors
       FROM regions WHERE strand <> '+'""",
)
def validate_bed(v):
    return src.validate_bed(v.sql(f"WITH {CHECK_LINES} SELECT * FROM check_lines")).drop("value")


#: Operations of every kind: insertions, skips, clips of both sorts, padding, = and X, and alignments without operations.
SHAPES = ["concat('3H5S', n, 'M4I', n + 2, 'M2D7M')", "concat(n, '=1X', n, '=300N', n + 5, 'M6S')", "concat('2S', n, 'M2P3I', n, 'M9H')", "concat('10I', n, 'X')", "'*'", "concat('5S', n, 'M5D', n + 1, 'M')"]
SHAPED = "CASE ref_start % 6 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(SHAPES)) + " END"


@query(
    "STR2_block_shapes",
    f"""WITH shaped AS (SELECT sample_id, read_id, ref_start, is_secondary, {SHAPED} AS cigar FROM (SELECT *, CAST(query_length AS VARCHAR) AS q, query_length AS n FROM alignments)),
        once AS (SELECT DISTINCT sample_id, read_id, ref_start, cigar FROM shaped),
        lists AS (SELECT *, regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1) AS ns, regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1) AS ops FROM once),
        steps AS (SELECT sample_id, read_id, ref_start, cigar, unnest(range(1, len(ops) + 1)) AS i, CAST(unnest(ns) AS BIGINT) AS n, unnest(ops) AS op FROM lists),
        places AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER w, 0) AS r, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END) OVER w, 0) AS q
          FROM steps WINDOW w AS (PARTITION BY sample_id, read_id, ref_start, cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT sample_id, read_id, ref_start, cigar, CAST(ref_start + r AS BIGINT) AS block_start, CAST(ref_start + r + n AS BIGINT) AS block_end, CAST(q AS BIGINT) AS read_offset FROM places WHERE op IN ('M', '=', 'X')""",
)
def block_shapes(v):
    rows = v.alignments.withColumn("n", F.col("query_length")).withColumn("cigar", F.expr(SHAPED))
    return aligned_blocks(rows.select("sample_id", "read_id", "ref_start", "cigar").distinct())
