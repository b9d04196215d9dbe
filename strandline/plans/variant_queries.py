"""Variant queries on the given tables."""

from pyspark.sql import functions as F

from strandline.operators import variants as va
from strandline.plans.registry import query

SUBSTRING = "contains(upper(regexp_extract(info, 'CLNSIG=([^;]*)', 1)), 'PATHOGENIC')"
VOTE = "coalesce(TRY_CAST(nullif(regexp_extract(info, 'CLNSIGCONF=[^;]*{w}\\(([0-9]+)\\)', 1), '') AS INT), 0)"
TERMS = f"""CASE WHEN lower(regexp_extract(info, 'CLNSIG=([^;]*)', 1)) IN ('pathogenic', 'likely_pathogenic') THEN TRUE WHEN contains(info, 'CLNSIG=Conflicting')
  THEN {VOTE.format(w='Pathogenic')} > {VOTE.format(w='Benign')} ELSE FALSE END"""


@query(
    "FLT10_variant_filter",
    f"SELECT chrom, pos, id, alt, qual FROM vcf WHERE filter = 'PASS' AND {SUBSTRING} AND qual >= 10 AND CAST(string_split(gt, ':')[2] AS DOUBLE) >= 20",
)
def variant_filter(v):
    return va.variant_filter(v.vcf, True, True, 10, 20).select("chrom", "pos", "id", "alt", "qual")


@query("FLT11_is_pathogenic", f"SELECT id, {SUBSTRING} AS by_text, {SUBSTRING} AS by_onc, {TERMS} AS by_terms FROM vcf")
def is_pathogenic(v):
    info = F.col("info")
    return v.vcf.select("id", *[va.is_pathogenic(info, m).alias(n) for m, n in (("substring", "by_text"), ("onc", "by_onc"), ("terms", "by_terms"))])


def _ann_sql(i: int) -> str:
    return f"a[{i + 1}] AS {va.ANN_FIELDS[i]}"


ANNOTATED = f"""parts AS (SELECT *, string_split(unnest(string_split(regexp_extract(info, 'ANN=([^;]*)', 1), ',')), '|') AS a FROM vcf),
  ann AS (SELECT DISTINCT chrom, pos, id, ref, alt, qual, filter, format, gt, CAST({SUBSTRING} AS VARCHAR) AS is_pathogenic, nullif(regexp_extract(info, 'CLNSIG=([^;]*)', 1), '') AS clnsig,
    nullif(regexp_extract(info, 'CLNSIGCONF=([^;]*)', 1), '') AS clnsigconf, nullif(regexp_extract(info, 'GENEINFO=([^;]*)', 1), '') AS geneinfo, {', '.join(_ann_sql(i) for i in range(16))} FROM parts WHERE len(a) >= 16)"""
_REST = ["is_pathogenic", "clnsig", "clnsigconf", "geneinfo", *va.ANN_FIELDS[1:]]


@query(
    "AGG23_vcf_annotations",
    f"""WITH {ANNOTATED} SELECT chrom, pos, id, ref, alt, qual, filter, format, gt, allele, {', '.join(f"nullif(string_agg(DISTINCT {c}, ', ' ORDER BY {c}), '') AS {c}" for c in _REST)}
        FROM ann GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10""",
)
def vcf_annotations(v):
    return va.vcf_annotations(v.vcf)


@query(
    "AGG24_variant_summary",
    f"""SELECT CASE WHEN length(ref) = length(alt) THEN 'snv' ELSE 'indel' END AS type, count(*) AS total_variants, count(*) FILTER ({SUBSTRING}) AS pathogenic_variants, count(DISTINCT concat(chrom, ':', CAST(pos AS VARCHAR))) AS sites,
        count(DISTINCT string_split(regexp_extract(info, 'ANN=([^;,]*)', 1), '|')[4]) FILTER ({SUBSTRING}) AS affected_genes FROM vcf GROUP BY 1""",
)
def variant_summary(v):
    return va.variant_summary(v.vcf)


@query(
    "AGG24_first_hgvs",
    "SELECT chrom, pos, id, alt, a[4] AS gene, a[10] AS hgvs_c, a[11] AS hgvs_p FROM (SELECT *, string_split(regexp_extract(info, 'ANN=([^;,]*)', 1), '|') AS a FROM vcf)",
)
def first_hgvs(v):
    return va.first_hgvs(v.vcf)


_N = ", ".join(f"count(*) FILTER (NOT is_del AND base = '{b}') AS n_{b.lower()}" for b in va.BASES)
PILE = f"""pc AS (SELECT sample_id, chrom, pos, {_N}, count(*) FILTER (is_del) AS indel, count(*) FILTER (NOT is_del) AS depth, coalesce(avg(qual) FILTER (NOT is_del), 0) AS mean_quality FROM pileup_bases GROUP BY 1, 2, 3),
  pr AS (SELECT *, CASE greatest(n_a, n_c, n_g, n_n, n_t) WHEN n_a THEN 'A' WHEN n_c THEN 'C' WHEN n_g THEN 'G' WHEN n_n THEN 'N' ELSE 'T' END AS reference FROM pc),
  pile AS (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN n_{b.lower()} > 0 AND reference <> '{b}' THEN concat('{b}:', CAST(n_{b.lower()} AS VARCHAR)) END" for b in va.BASES)}) AS variant_alleles FROM pr)"""


@query("AGG19_pileup", f"WITH {PILE} SELECT *, variant_alleles <> '' AS has_variants FROM pile")
def pileup(v):
    return va.pileup(v.pileup_bases)


@query(
    "AGG19_pileup_reads",
    "SELECT DISTINCT sample_id, chrom, pos, read_id FROM pileup_bases WHERE NOT is_del",
)
def pileup_reads(v):
    return va.pileup_reads(v.pileup_bases)


@query("JN11_variants_at_pileup", f"WITH {PILE} SELECT v.chrom, v.pos, v.id, v.alt, p.sample_id, p.depth, p.reference FROM vcf v JOIN pile p ON v.chrom = p.chrom AND v.pos = p.pos")
def variants_at_pileup(v):
    return va.variants_at_pileup(v.vcf, va.pileup(v.pileup_bases)).select("chrom", "pos", "id", "alt", "sample_id", "depth", "reference")


_PICK = "CASE {c} WHEN 'A' THEN n_a WHEN 'C' THEN n_c WHEN 'G' THEN n_g WHEN 'N' THEN n_n WHEN 'T' THEN n_t ELSE 0 END"


@query(
    "AGG21_variant_evidence",
    f"""WITH {PILE}, e AS (SELECT v.chrom, v.pos, v.id, v.ref, v.alt, p.sample_id, depth, length(v.ref) <> length(v.alt) AS ind, length(v.ref) > length(v.alt) AS del, p.reference <> substr(v.ref, 1, 1) AS mis,
          {_PICK.format(c='v.ref')} AS rs, {_PICK.format(c='v.alt')} AS als FROM vcf v JOIN pile p ON v.chrom = p.chrom AND v.pos = p.pos),
        f AS (SELECT *, CASE WHEN NOT ind THEN rs WHEN del OR mis THEN 0 ELSE rs END AS ref_support, CASE WHEN ind THEN 0 ELSE als END AS alt_support, CASE WHEN NOT ind AND depth > 0 THEN als / depth ELSE 0 END AS vaf FROM e)
        SELECT chrom, pos, id, alt, sample_id, depth, ref_support, alt_support, vaf, CASE WHEN del THEN 'indel_requires_review' WHEN ind AND mis THEN 'reference_mismatch' WHEN ind THEN 'insertion_requires_review'
          WHEN alt_support = 0 THEN 'no_support' WHEN alt_support < 3 THEN 'low_support' WHEN vaf < 0.1 THEN 'low_frequency' WHEN vaf < 0.3 THEN 'medium_frequency' ELSE 'high_frequency' END AS evidence_level,
        CASE WHEN ind THEN 'indel_requires_review' WHEN depth <= 0 THEN 'unknown' WHEN vaf > 0.8 THEN 'homozygous' WHEN vaf > 0.2 THEN 'heterozygous' ELSE 'low_frequency' END AS zygosity,
        CASE WHEN ind THEN 'indel' ELSE 'snv' END AS variant_type FROM f""",
)
def variant_evidence(v):
    out = va.variant_evidence(va.variants_at_pileup(v.vcf, va.pileup(v.pileup_bases)))
    return out.select("chrom", "pos", "id", "alt", "sample_id", "depth", "ref_support", "alt_support", "vaf", "evidence_level", "zygosity", "variant_type")


def _report(regions: str, key: str) -> str:
    return f"""SELECT p.sample_id, p.chrom, {key}, start_pos, end_pos, CAST(sum(depth) AS BIGINT) AS total_coverage, avg(depth) AS mean_coverage, stddev_pop(depth) AS coverage_std, CAST(coalesce(sum(n), 0) AS BIGINT) AS variants_found,
      CASE WHEN avg(depth) >= 30 AND end_pos - start_pos >= 1000 THEN 'high' WHEN avg(depth) >= 10 AND end_pos - start_pos >= 500 THEN 'medium' ELSE 'low' END AS quality
      FROM pile p JOIN {regions} g ON g.chrom = p.chrom AND p.pos BETWEEN g.start_pos AND g.end_pos LEFT JOIN (SELECT chrom, pos, count(*) AS n FROM vcf GROUP BY 1, 2) k ON k.chrom = p.chrom AND k.pos = p.pos GROUP BY 1, 2, 3, 4, 5"""


@query("AGG20_region_report", f"WITH {PILE} {_report('regions', 'target_id')}")
def region_report(v):
    return va.region_report(va.pileup(v.pileup_bases), v.regions, v.vcf)


SPANS = "spans AS (SELECT string_split(regexp_extract(info, 'GENEINFO=([^;]*)', 1), ':')[1] AS gene, chrom, min(pos) AS start_pos, max(pos) AS end_pos FROM vcf GROUP BY 1, 2)"


@query("AGG20_gene_report", f"WITH {PILE}, {SPANS} {_report('spans', 'gene')}")
def gene_report(v):
    return va.region_report(va.pileup(v.pileup_bases), va.gene_spans(v.vcf), v.vcf, key=["gene"])


GENES = f"""{PILE}, gv AS (SELECT p.sample_id, string_split(regexp_extract(info, 'GENEINFO=([^;]*)', 1), ':')[1] AS gene, count(*) AS total_variants, count(*) FILTER (depth >= 10) AS high_coverage_variants,
  count(*) FILTER (depth < 10) AS low_coverage_variants, max(depth) AS max_depth FROM vcf v JOIN pile p ON v.chrom = p.chrom AND v.pos = p.pos WHERE {SUBSTRING} GROUP BY 1, 2),
  gs AS (SELECT *, CASE WHEN high_coverage_variants > 0 THEN 'present_with_good_coverage' ELSE 'present_but_low_coverage' END AS pathogenic_status FROM gv)"""


def gene_summary(v):
    return va.gene_variant_summary(va.variants_at_pileup(va.variant_filter(v.vcf, pathogenic_only=True), va.pileup(v.pileup_bases)))


@query("AGG22_gene_variant_summary", f"WITH {GENES} SELECT * FROM gs")
def gene_variant_summary(v):
    return gene_summary(v)


@query("AGG22_top_genes", f"WITH {GENES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY max_depth DESC, gene) AS rank FROM gs) WHERE rank <= 20")
def top_genes(v):
    return va.top_genes(gene_summary(v))


GENE = "string_split(regexp_extract(info, 'GENEINFO=([^;]*)', 1), ':')[1]"


def gene_rows(v):
    joined = va.variants_at_pileup(va.variant_filter(v.vcf, pathogenic_only=True), va.pileup(v.pileup_bases))
    return va.gene_variant_rows(va.variant_evidence(joined))


@query(
    "AGG22_variant_rows",
    f"""WITH {PILE} SELECT p.sample_id, {GENE} AS gene, v.chrom, v.pos, v.id, v.ref, v.alt, depth, CASE WHEN length(v.ref) <> length(v.alt) THEN 0 ELSE {_PICK.format(c='v.alt')} END AS alt_support,
        CASE WHEN depth >= 10 THEN 'high' ELSE 'low' END AS coverage_status FROM vcf v JOIN pile p ON v.chrom = p.chrom AND v.pos = p.pos WHERE {SUBSTRING}""",
)
def gene_variant_rows(v):
    return gene_rows(v).select("sample_id", "gene", "chrom", "pos", "id", "ref", "alt", "depth", "alt_support", "coverage_status")


@query(
    "AGG22_gene_regions",
    f"""WITH {PILE} SELECT p.sample_id, {GENE} AS gene, count(DISTINCT g.target_id) AS regions FROM vcf v JOIN pile p ON v.chrom = p.chrom AND v.pos = p.pos
        JOIN regions g ON g.chrom = v.chrom AND v.pos BETWEEN g.start_pos AND g.end_pos WHERE {SUBSTRING} GROUP BY 1, 2""",
)
def gene_regions(v):
    return va.gene_regions(gene_rows(v), v.regions)


@query("AGG22_only_low_coverage", f"WITH {GENES.replace('depth >= 10', 'depth >= 25').replace('depth < 10', 'depth < 25')} SELECT * FROM gs WHERE high_coverage_variants = 0")
def only_low_coverage(v):
    """With 25 reads for good coverage, which about half of the genes have."""
    joined = va.variants_at_pileup(va.variant_filter(v.vcf, pathogenic_only=True), va.pileup(v.pileup_bases))
    return va.only_low_coverage(va.gene_variant_summary(joined, 25))
