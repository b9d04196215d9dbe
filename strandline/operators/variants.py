"""Variant annotation, pileup and evidence tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.tags import info_map
from strandline.operators.intervals import interval_join

#: fixed values: the sub-fields of an ANN entry, in order
ANN_FIELDS = ("allele", "annotation", "impact", "gene_name", "gene_id", "feature_type", "feature_id", "transcript_biotype", "rank", "hgvs_c", "hgvs_p",
              "cdna_pos", "cds_pos", "aa_pos", "distance", "messages")
INFO_FIELDS = ("CLNSIG", "CLNSIGCONF", "GENEINFO")
SITE = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "format", "gt")


def is_pathogenic(info: Column, mode: str = "substring") -> Column:
    """``pathogenic_fields`` of an INFO text."""
    return pathogenic_fields(info_map(info), mode)


def pathogenic_fields(fields: Column, mode: str = "substring") -> Column:
    """Pathogenic by text (``substring``), by CLNSIG or else ONC (``onc``), or by exact terms.

    ``terms`` splits CLNSIG on slash, bar and comma; conflicting records are
    decided by the counts in CLNSIGCONF.
    """
    sig = fields["CLNSIG"]
    if mode == "substring":
        return F.contains(F.upper(F.coalesce(sig, F.lit(""))), F.lit("PATHOGENIC"))
    if mode == "onc":
        return F.contains(F.upper(F.coalesce(sig, fields["ONC"], F.lit(""))), F.lit("PATHOGENIC"))
    terms = F.transform(F.split(F.lower(F.coalesce(sig, F.lit(""))), "[/|,]"), lambda t: F.replace(F.trim(t), F.lit(" "), F.lit("_")))
    exact = F.exists(terms, lambda t: t.isin("pathogenic", "likely_pathogenic"))
    votes = F.split(F.lower(F.coalesce(fields["CLNSIGCONF"], F.lit(""))), "\\|")

    def count(word):
        hits = F.filter(votes, lambda x: F.contains(x, F.lit(word)))
        return F.aggregate(hits, F.lit(0), lambda acc, x: acc + F.coalesce(F.regexp_extract(x, "\\(([0-9]+)\\)", 1).try_cast("int"), F.lit(0)))

    conflict = F.exists(terms, lambda t: F.contains(t, F.lit("conflicting")))
    return F.when(exact, True).when(conflict, count("pathogenic") > count("benign")).otherwise(False)


def depth_from_genotype(fmt: Column, gt: Column) -> Column:
    """The DP value of the sample column, null where it is missing."""
    at = F.array_position(F.split(fmt, ":"), "DP")
    return F.when(at > 0, F.try_element_at(F.split(gt, ":"), at.cast("int"))).try_cast("double")


def variant_filter(vcf: DataFrame, pass_only=False, pathogenic_only=False, min_qual: float | None = None, min_dp: float | None = None) -> DataFrame:
    """All conditions together; a missing quality or depth fails a set minimum."""
    out = vcf
    if pass_only:
        out = out.filter(F.upper(F.trim("filter")) == "PASS")
    if pathogenic_only:
        out = out.filter(is_pathogenic(F.col("info")))
    if min_qual is not None:
        out = out.filter(F.col("qual").try_cast("double") >= min_qual)
    if min_dp is not None:
        out = out.filter(depth_from_genotype(F.col("format"), F.col("gt")) >= min_dp)
    return out


def explode_annotations(vcf: DataFrame) -> DataFrame:
    """One row per annotation with all sub-fields; variants without one keep a row."""
    # as a column of its own the text is parsed once per row, not once per field
    vcf = vcf.withColumn("_info", info_map(F.col("info")))
    fields = F.col("_info")
    entries = F.filter(F.transform(F.split(F.coalesce(fields["ANN"], F.lit("")), ","), lambda e: F.split(e, "\\|")), lambda p: F.size(p) >= len(ANN_FIELDS))
    rows = vcf.withColumn("is_pathogenic", pathogenic_fields(fields)).withColumn("_e", F.explode_outer(entries))
    return rows.select(*SITE, "is_pathogenic", *[fields[k].alias(k.lower()) for k in INFO_FIELDS], *[F.col("_e")[i].alias(n) for i, n in enumerate(ANN_FIELDS)])


def vcf_annotations(vcf: DataFrame) -> DataFrame:
    """Annotations per site and allele; every other column as its sorted distinct values."""
    rows = explode_annotations(vcf).distinct()
    rest = [c for c in rows.columns if c not in (*SITE, "allele")]

    def joined(c):
        return F.nullif(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ", "), F.lit("")).alias(c)

    return rows.groupBy(*SITE, "allele").agg(*[joined(c) for c in rest])


def variant_summary(vcf: DataFrame) -> DataFrame:
    """Totals per variant type: variants, pathogenic ones, sites and affected genes."""
    fields = info_map(F.col("info"))
    first = F.split(F.split(fields["ANN"], ",")[0], "\\|")
    kind = F.when(F.length("ref") == F.length("alt"), "snv").otherwise("indel")
    rows = vcf.select(kind.alias("type"), "chrom", "pos", is_pathogenic(F.col("info")).alias("bad"), F.try_element_at(first, F.lit(4)).alias("gene"))
    base = rows.groupBy("type").agg(F.count(F.lit(1)).alias("total_variants"), F.count_if("bad").alias("pathogenic_variants"))
    sites = rows.select("type", "chrom", "pos").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("sites"))
    genes = rows.filter("bad AND gene IS NOT NULL").select("type", "gene").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("affected_genes"))
    return base.join(sites, "type").join(genes, "type", "left").fillna(0, ["affected_genes"])


def first_hgvs(vcf: DataFrame) -> DataFrame:
    """Gene and coding and protein change of the first annotation."""
    first = F.split(F.split(info_map(F.col("info"))["ANN"], ",")[0], "\\|")
    return vcf.select("chrom", "pos", "id", "alt", *[F.try_element_at(first, F.lit(i)).alias(n) for i, n in ((4, "gene"), (10, "hgvs_c"), (11, "hgvs_p"))])


PLACE = ["sample_id", "chrom", "pos"]
BASES = ("A", "C", "G", "N", "T")


def pileup(bases: DataFrame) -> DataFrame:
    """Base counts, depth, mean quality and other alleles per position.

    The reference letter is the most common base, ties by letter.
    """
    seen, letter = ~F.col("is_del"), F.upper("base")

    def n(b):
        return F.count_if(seen & ((letter == b) if b != "N" else ~letter.isin(*[x for x in BASES if x != "N"]))).alias(f"n_{b.lower()}")

    per = bases.groupBy(*PLACE).agg(*[n(b) for b in BASES], F.count_if("is_del").alias("indel"), F.count_if(seen).alias("depth"), F.avg(F.when(seen, F.col("qual"))).alias("mean_quality"))
    table = F.array(*[F.struct((-F.col(f"n_{b.lower()}")).alias("k"), F.lit(b).alias("b"), F.col(f"n_{b.lower()}").alias("n")) for b in BASES])
    out = per.withColumn("reference", F.array_min(table)["b"])
    others = F.filter(table, lambda x: (x["n"] > 0) & (x["b"] != F.col("reference")))
    alleles = F.array_join(F.transform(F.array_sort(F.transform(others, lambda x: F.struct(x["b"].alias("b"), x["n"].alias("n")))), lambda x: F.concat(x["b"], F.lit(":"), x["n"].cast("string"))), ",")
    return out.withColumns({"mean_quality": F.coalesce("mean_quality", F.lit(0.0)), "variant_alleles": alleles}).withColumn("has_variants", F.col("variant_alleles") != "")


def pileup_reads(bases: DataFrame) -> DataFrame:
    """Every read at every position, one row each, so that deep positions need no list."""
    return bases.filter("NOT is_del").select(*PLACE, "read_id").distinct()


def variants_at_pileup(vcf: DataFrame, piled: DataFrame) -> DataFrame:
    return vcf.select("chrom", "pos", "id", "ref", "alt", "info").join(piled, ["chrom", "pos"])


def variant_evidence(joined: DataFrame) -> DataFrame:
    """Support of a variant in the pileup, its level and zygosity."""
    counts = F.create_map(*[x for b in BASES for x in (F.lit(b), F.col(f"n_{b.lower()}"))])

    def support(base):
        return F.coalesce(F.try_element_at(counts, F.upper(base)), F.lit(0))

    rl, al = F.length("ref"), F.length("alt")
    indel, deletion = rl != al, rl > al
    mismatch = F.col("reference") != F.substring("ref", 1, 1)
    ref_n = F.when(~indel, support(F.col("ref"))).when(deletion | mismatch, 0).otherwise(support(F.substring("ref", 1, 1)))
    alt_n = F.when(indel, 0).otherwise(support(F.col("alt")))
    vaf = F.when(~indel & (F.col("depth") > 0), alt_n / F.col("depth")).otherwise(0.0)
    level = (
        F.when(deletion, "indel_requires_review").when(indel & mismatch, "reference_mismatch").when(indel, "insertion_requires_review")
        .when(F.col("alt_support") == 0, "no_support").when(F.col("alt_support") < 3, "low_support").when(F.col("vaf") < 0.1, "low_frequency")
        .when(F.col("vaf") < 0.3, "medium_frequency").otherwise("high_frequency")
    )
    zygosity = F.when(indel, "indel_requires_review").when(F.col("depth") <= 0, "unknown").when(F.col("vaf") > 0.8, "homozygous").when(F.col("vaf") > 0.2, "heterozygous").otherwise("low_frequency")
    out = joined.withColumns({"ref_support": ref_n, "alt_support": alt_n, "vaf": vaf})
    return out.withColumns({"evidence_level": level, "zygosity": zygosity, "variant_type": F.when(indel, "indel").otherwise("snv")})


def region_report(piled: DataFrame, regions: DataFrame, variants: DataFrame, key: Sequence[str] = ("target_id",)) -> DataFrame:
    """Depth statistics, quality and number of variants per sample and region."""
    keys = list(key)
    panel = regions.select("chrom", "start_pos", "end_pos", *keys)
    spots = piled.select(*PLACE, "depth").withColumn("_e", F.col("pos"))
    hit = interval_join(spots, panel, left_span=("pos", "_e"), right_span=("start_pos", "end_pos"), closed=True)
    known = variants.select("chrom", "pos").groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("_v"))
    hit = hit.join(known, ["chrom", "pos"], "left")
    out = hit.groupBy("sample_id", "chrom", *keys, "start_pos", "end_pos").agg(
        F.sum("depth").alias("total_coverage"), F.avg("depth").alias("mean_coverage"), F.stddev_pop("depth").alias("coverage_std"), F.coalesce(F.sum("_v"), F.lit(0)).alias("variants_found")
    )
    size, mean = F.col("end_pos") - F.col("start_pos"), F.col("mean_coverage")
    return out.withColumn("quality", F.when((mean >= 30) & (size >= 1000), "high").when((mean >= 10) & (size >= 500), "medium").otherwise("low"))


def gene_spans(variants: DataFrame) -> DataFrame:
    """First to last position per gene symbol."""
    symbol = F.substring_index(info_map(F.col("info"))["GENEINFO"], ":", 1)
    return variants.select(symbol.alias("gene"), "chrom", "pos").filter("gene IS NOT NULL").groupBy("gene", "chrom").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"))


def gene_variant_summary(joined: DataFrame, min_depth: int = 10) -> DataFrame:
    """Variants, well and poorly covered, per sample and gene symbol."""
    symbol = F.substring_index(info_map(F.col("info"))["GENEINFO"], ":", 1)
    rows = joined.withColumn("gene", symbol)
    high = F.count_if(F.col("depth") >= min_depth)
    out = rows.groupBy("sample_id", "gene").agg(F.count(F.lit(1)).alias("total_variants"), high.alias("high_coverage_variants"), F.count_if(F.col("depth") < min_depth).alias("low_coverage_variants"), F.max("depth").alias("max_depth"))
    status = F.when(F.col("high_coverage_variants") > 0, "present_with_good_coverage").otherwise("present_but_low_coverage")
    return out.withColumn("pathogenic_status", status)


def gene_variant_rows(evidence: DataFrame, min_depth: int = 10) -> DataFrame:
    """One row per sample, gene and variant of a summary, with its evidence and coverage status."""
    status = F.when(F.col("depth") >= min_depth, "high").otherwise("low")
    symbol = F.substring_index(info_map(F.col("info"))["GENEINFO"], ":", 1)
    return evidence.select("sample_id", symbol.alias("gene"), "chrom", "pos", "id", "ref", "alt", "depth", "alt_support", "vaf", "evidence_level", "zygosity", status.alias("coverage_status"))


def gene_regions(rows: DataFrame, regions: DataFrame, key: str = "target_id") -> DataFrame:
    """How many regions the variants of a sample's gene lie in."""
    spots = rows.select("sample_id", "gene", "chrom", "pos").distinct().withColumn("_e", F.col("pos"))
    hit = interval_join(spots, regions.select("chrom", "start_pos", "end_pos", key), left_span=("pos", "_e"), closed=True)
    return hit.select("sample_id", "gene", key).distinct().groupBy("sample_id", "gene").agg(F.count(F.lit(1)).alias("regions"))


def only_low_coverage(summary: DataFrame) -> DataFrame:
    """Genes that have variants, none of them well covered."""
    return summary.filter((F.col("high_coverage_variants") == 0) & (F.col("total_variants") > 0))


def top_genes(summary: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` genes of each sample with the deepest variant."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("max_depth"), "gene")
    return summary.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
