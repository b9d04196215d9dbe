"""Gene fusion candidates, tags, breakpoints and clusters.

Everything is keyed by ``(sample_id, read_id)``. Sets of genes or reads are
reduced to distinct rows before they are counted or listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.tags import supplementary_spans
from strandline.operators.graph import connected_components
from strandline.operators.intervals import BUCKET, interval_join
from strandline.operators.qc import failing_reads, qs_filter
from strandline.operators.ranges import TILE, merge_nearby
from strandline.session import cut_lineage, dealt_by_some_keys, keep, written

READ = ["sample_id", "read_id"]

#: fixed values: the thresholds of the detection rules
MIN_MAPQ = 49
MIN_SPAN = 249
MIN_OVERLAP = 99
SIMILARITY = 50
READ_SUPPORT = 3
VALIDATED_SUPPORT = 4


def gate_rule() -> Column:
    span = F.col("ref_end") - F.col("ref_start")
    return ~F.col("is_unmapped") & ~F.col("is_secondary") & F.col("sa").isNotNull() & (F.col("chrom") != "chrM") & (F.col("mapq") > MIN_MAPQ) & (span > MIN_SPAN)


def fusion_gate(alignments: DataFrame) -> DataFrame:
    """Mapped, non-secondary alignments with SA text, off chrM, long and well mapped."""
    return alignments.filter(gate_rule()).withColumn("mapping_span", F.col("ref_end") - F.col("ref_start"))


#: fixed values: the columns of a candidate row
CANDIDATE = ["sample_id", "candidate_type", "read_id", "gene", "gene_start", "gene_end", "chrom", "ref_start", "ref_end", "mapq", "strand",
             "read_start", "read_end", "is_secondary", "is_supplementary", "mapping_span"]


#: Alignments for each of which the steps after the candidates get one task.
TASK_ROWS = 500_000


def tasks_for(alignments: DataFrame) -> int:
    """Tasks for the steps per read: as the alignments grow there are more of them, not larger ones."""
    return max(int(alignments.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(alignments.count() / TASK_ROWS))


def fusion_candidates(gated: DataFrame, regions: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every gated alignment with every region it overlaps by more than 99 bases.

    With ``tasks`` the rows are dealt by read to that many partitions once, and what
    follows per read needs no other shuffle.
    """
    panel = regions.select("chrom", "start_pos", "end_pos", F.col("name").alias("gene"), F.col("region_type").alias("candidate_type"))
    rows = gated.select(*[c for c in CANDIDATE if c in gated.columns])
    hits = interval_join(rows, panel, min_overlap=MIN_OVERLAP)
    rows = hits.withColumnsRenamed({"start_pos": "gene_start", "end_pos": "gene_end"}).select(*CANDIDATE)
    return rows.repartition(tasks, *READ) if tasks else rows


def overlap_artifacts(candidates: DataFrame, distance: int = SIMILARITY) -> DataFrame:
    """Reads with two candidate rows on a chromosome within ``distance`` at both ends.

    Starts and ends are put on a grid of ``distance + 1``: two rows in one cell
    are close by construction, so a cell needs a count only. Cells that hold one
    row meet their half of the neighbouring cells by one more aggregate, with at
    most four visitors per cell whatever the size of a read.
    """
    key = [*READ, "chrom"]
    side = distance + 1
    row = F.struct("ref_start", "ref_end", "gene", "gene_start", "gene_end")
    cells = (
        candidates.withColumns({"i": F.floor(F.col("ref_start") / side), "j": F.floor(F.col("ref_end") / side)})
        .groupBy(*key, "i", "j")
        .agg(F.min(row).alias("a"), F.max(row).alias("z"))
        .select(*key, "i", "j", (F.col("a") != F.col("z")).alias("many"), F.col("a.ref_start").alias("s"), F.col("a.ref_end").alias("e"))
    )
    # every cell goes to itself and to its later neighbours; a cell is one row by now,
    # so a target meets at most one resident and four visitors
    offsets = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("di"), F.lit(b).alias("dj")) for k, (a, b) in enumerate(offsets)])
    moved = cells.withColumn("d", F.explode(steps)).select(*key, (F.col("i") + F.col("d.di")).alias("i"), (F.col("j") + F.col("d.dj")).alias("j"), "many", "s", "e", F.col("d.k").alias("k"))

    def at(k, what):
        return F.max(F.when(F.col("k") == k, F.col(what)))

    met = moved.groupBy(*key, "i", "j").agg(at(0, "many").alias("many"), *[at(k, c).alias(f"{c}{k}") for k in range(5) for c in ("s", "e")])
    close = F.lit(False)
    for k in range(1, 5):
        close = close | F.coalesce((F.abs(F.col(f"s{k}") - F.col("s0")) <= distance) & (F.abs(F.col(f"e{k}") - F.col("e0")) <= distance), F.lit(False))
    return met.filter(F.col("many") | close).select(*READ).distinct()


def without_artifacts(candidates: DataFrame) -> DataFrame:
    return candidates.join(overlap_artifacts(candidates), READ, "left_anti")


def multi_gene_reads(candidates: DataFrame) -> DataFrame:
    """All rows of reads with more than one gene (smallest and largest differ)."""
    reads = candidates.groupBy(*READ).agg(F.min("gene").alias("a"), F.max("gene").alias("z")).filter("a <> z").select(*READ)
    return candidates.join(reads, READ, "left_semi")


def read_tags(candidates: DataFrame) -> DataFrame:
    """The sorted distinct genes of each read as one text; reads of one gene are left out."""
    genes = candidates.select(*READ, "gene").distinct().groupBy(*READ).agg(F.array_sort(F.collect_list("gene")).alias("g"))
    return genes.filter(F.size("g") > 1).select(*READ, F.array_join("g", ",").alias("tag"))


def gene_tags(candidates: DataFrame, min_support: int = READ_SUPPORT) -> DataFrame:
    """Gene combinations with enough reads, per sample."""
    return read_tags(candidates).groupBy("sample_id", "tag").agg(F.count(F.lit(1)).alias("reads")).filter(F.col("reads") >= min_support)


def supported_rows(candidates: DataFrame, min_support: int = READ_SUPPORT) -> DataFrame:
    """Candidate rows of reads whose tag has enough support, with the tag."""
    tags = read_tags(candidates)
    good = tags.join(gene_tags(candidates, min_support).select("sample_id", "tag"), ["sample_id", "tag"], "left_semi")
    return candidates.join(good, READ)


def new_tags(valid: DataFrame, before: DataFrame) -> DataFrame:
    return valid.select("sample_id", "tag").join(before.select("sample_id", "tag"), ["sample_id", "tag"], "left_anti")


def validate_fusion(rows: DataFrame) -> DataFrame:
    """First failing rule of each row with its columns ``has_sa, multi_gene, overlap, support``."""
    reason = (
        F.when(~F.col("has_sa"), "no_supplementary")
        .when(~F.col("multi_gene"), "single_gene")
        .when(F.col("mapq") <= MIN_MAPQ, "mapping_quality")
        .when(F.col("mapping_span") <= MIN_SPAN, "mapping_span")
        .when(F.col("overlap") < MIN_OVERLAP, "gene_overlap")
        .when(F.col("support") < READ_SUPPORT, "read_support")
        .otherwise("passed")
    )
    return rows.withColumn("reason", reason).withColumn("valid", F.col("reason") == "passed")


def gene_groups(candidates: DataFrame, min_support: int = READ_SUPPORT) -> DataFrame:
    """Components of the two-gene tags that at least ``min_support`` reads touch."""
    candidates = keep(candidates)
    good = supported_rows(candidates, min_support)
    edges = gene_tags(candidates, min_support).filter(F.size(F.split("tag", ",")) == 2)
    parts = F.split("tag", ",")
    network = connected_components(edges.select("sample_id", parts[0].alias("a"), parts[1].alias("b")), "a", "b", ["sample_id"])
    touched = good.select("sample_id", "read_id", F.col("gene").alias("vertex")).distinct().join(network, ["sample_id", "vertex"])
    reads = touched.select("sample_id", "component", "read_id").distinct().groupBy("sample_id", "component").agg(F.count(F.lit(1)).alias("reads"))
    genes = network.groupBy("sample_id", "component").agg(F.array_join(F.array_sort(F.collect_list("vertex")), ",").alias("genes"))
    return genes.join(reads, ["sample_id", "component"]).filter(F.col("reads") >= min_support).select("sample_id", "genes", "reads")


def validated_groups(groups: DataFrame, validated: DataFrame) -> DataFrame:
    """Groups that hold both genes of at least one validated pair."""
    member = groups.select("sample_id", "genes", F.explode(F.split("genes", ",")).alias("gene"))
    first = member.select("sample_id", F.col("gene").alias("gene1"), F.col("genes").alias("group1"))
    second = member.select("sample_id", F.col("gene").alias("gene2"), F.col("genes").alias("group2"))
    pairs = validated.select("sample_id", "gene1", "gene2").distinct()
    hit = pairs.join(first, ["sample_id", "gene1"]).join(second, ["sample_id", "gene2"]).filter("group1 = group2")
    return groups.join(hit.select("sample_id", F.col("group1").alias("genes")).distinct(), ["sample_id", "genes"], "left_semi")


def fusion_breakpoints(candidates: DataFrame, width: int = 10_000, min_support: int = READ_SUPPORT) -> DataFrame:
    """Distinct alignments of supported reads, as windows around their midpoints."""
    rows = supported_rows(candidates, min_support).filter("ref_start > 0 AND ref_end > ref_start")
    spots = rows.select("sample_id", "chrom", "ref_start", "ref_end", "gene", F.col("candidate_type").alias("source")).distinct()
    mid = F.expr("(ref_start + ref_end) div 2")
    return spots.select("sample_id", "chrom", "gene", "source", "ref_start", "ref_end", F.greatest(F.lit(0), mid - width).alias("start_pos"), (mid + width).alias("end_pos"))


def fusion_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("sample_id", "candidate_type").agg(F.count(F.lit(1)).alias("rows"))


def fusion_funnel(alignments: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows left after each rule, per sample.

    Each alignment carries the number of the last rule it passes, and so does each
    candidate: two counts by that number, summed from it down, are all stages. The
    candidates are written once, for the rules after them look at whole reads.
    """
    marked = alignments.join(failing_reads(alignments).withColumn("_bad", F.lit(True)), READ, "left")
    passed = F.when(F.col("_bad"), 1).when(gate_rule(), 3).otherwise(2)
    by_rule = marked.groupBy("sample_id", passed.alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    candidates = cut_lineage(fusion_candidates(fusion_gate(qs_filter(alignments)), regions, tasks_for(alignments)))
    artifacts = overlap_artifacts(candidates).withColumn("_art", F.lit(True))
    tags = read_tags(candidates)
    support = tags.join(artifacts, READ, "left_anti").groupBy("sample_id", "tag").agg(F.count(F.lit(1)).alias("_reads"))
    reads = tags.join(support, ["sample_id", "tag"], "left").select(*READ, F.coalesce("_reads", F.lit(0)).alias("_reads"))
    rows = candidates.groupBy(*READ).agg(F.count(F.lit(1)).alias("_n")).join(artifacts, READ, "left").join(reads, READ, "left")
    passed = F.when(F.col("_art"), 4).when(F.col("_reads").isNull(), 5).when(F.col("_reads") < READ_SUPPORT, 6).otherwise(7)
    by_rule = by_rule.unionByName(rows.groupBy("sample_id", passed.alias("_k")).agg(F.sum("_n").alias("n")))
    names = ["1_alignments", "2_quality", "3_gated", "4_candidates", "5_without_artifacts", "6_multi_gene", "7_supported"]
    stages = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("stage")) for k, n in enumerate(names, 1)])
    # Alignments fill the stages up to the gate, candidates those after it.
    spread = by_rule.withColumn("s", F.explode(F.filter(stages, lambda s: (s["k"] <= F.col("_k")) & ((s["k"] > 3) == (F.col("_k") > 3)))))
    return spread.groupBy("sample_id", F.col("s.stage").alias("stage")).agg(F.sum("n").alias("rows"))


def search_reads(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows and distinct reads of wanted read ids per candidate type."""
    rows = candidates.join(ids.select(*READ).distinct(), READ, "left_semi")
    per_read = rows.groupBy("candidate_type", *READ).agg(F.count(F.lit(1)).alias("n"))
    return per_read.groupBy("candidate_type").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("reads"))


def new_reads_only(rows: DataFrame, processed: DataFrame) -> DataFrame:
    return rows.join(processed.select(*READ).distinct(), READ, "left_anti")


def reads_with_both(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(*READ).distinct().join(second.select(*READ), READ, "left_semi")


# --- gene pairs and their breakpoint clusters ---------------------------------


def gene_alignment_pick(candidates: DataFrame) -> DataFrame:
    """The first row per read and gene in coordinate order, by ``min`` of a struct."""
    at = F.struct("ref_start", "ref_end", "chrom", "strand", "mapq", "mapping_span")
    return candidates.groupBy(*READ, "gene").agg(F.min(at).alias("r")).select(*READ, "gene", "r.*")


def gene_pairs_per_read(candidates: DataFrame) -> DataFrame:
    """All gene pairs of a read, with the picked alignment of each gene."""
    pick = gene_alignment_pick(candidates)

    def side(n):
        names = {"gene": f"gene{n}", "chrom": f"chr{n}", "ref_start": f"start{n}", "ref_end": f"end{n}", "strand": f"strand{n}", "mapq": f"_q{n}", "mapping_span": f"_s{n}"}
        return pick.select(*READ, *[F.col(c).alias(a) for c, a in names.items()])

    pairs = side(1).join(side(2), READ).filter("gene1 < gene2")
    return pairs.withColumns({"min_mapq": F.least("_q1", "_q2"), "min_span": F.least("_s1", "_s2")}).drop("_q1", "_q2", "_s1", "_s2")


PAIR = ["sample_id", "gene1", "gene2", "chr1", "chr2"]


def _seed_clusters(positions: DataFrame, keys: Sequence[str], distance: int) -> DataFrame:
    """Greedy clusters that compare with their first position only.

    In (start, end) order a position joins a seed exactly when it starts at most
    ``distance`` after the seed's end, so the clusters are runs of starts. Per
    start only the smallest and largest end matter; a group therefore holds at
    most one row per base of a gene, however many reads there are. Those rows pass
    in order, and a task holds the open cluster only, never a list of them.
    """
    keys = list(keys)
    starts = positions.groupBy(*keys, "start").agg(F.min("end").alias("first_end"), F.max("end").alias("last_end"))
    schema = starts.select(*keys, F.col("start").alias("cluster"), F.col("start").alias("c_start"), F.col("last_end").alias("c_end")).schema
    names = [*keys, "cluster", "c_start", "c_end"]

    def passed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, cluster, c_start, c_end, limit = None, 0, 0, 0, 0
        for pdf in pdfs:
            closed = []
            for *place, start, first_end, last_end in pdf[[*keys, "start", "first_end", "last_end"]].itertuples(index=False, name=None):
                if place == here and start <= limit:
                    c_end = max(c_end, last_end)
                    continue
                if here is not None:
                    closed.append((*here, cluster, c_start, c_end))
                cluster = cluster + 1 if place == here else 0
                here, c_start, c_end, limit = place, start, last_end, first_end + distance
            yield pd.DataFrame(closed, columns=names)
        if here is not None:
            yield pd.DataFrame([(*here, cluster, c_start, c_end)], columns=names)

    ordered = starts.repartition(*keys).sortWithinPartitions(*keys, "start")
    return ordered.mapInPandas(passed, schema)


#: Rows of padded clusters per bucket up to which they go to every task; more of them are sort-merged.
SENT_ROWS = 100_000


def _on_clusters(rows: DataFrame, clusters: DataFrame, n: int, distance: int) -> DataFrame:
    """``rows`` with every cluster of gene ``n`` that has a member within ``distance``.

    The clusters are padded, not the rows, so that nearly all rows are in one bucket. They
    are counted in their buckets before they are broadcast.
    """
    start, end, c_start, c_end = (F.col(f"{c}{n}") for c in ("start", "end", "c_start", "c_end"))
    clusters = clusters.withColumnsRenamed({c: f"{c}{n}" for c in ("cluster", "c_start", "c_end")}).withColumns({f"_p{n}": c_start - distance, f"_q{n}": c_end + distance})
    buckets = F.floor(F.col(f"_q{n}") / BUCKET) - F.floor(F.col(f"_p{n}") / BUCKET) + 1
    if (clusters.agg(F.sum(buckets)).first()[0] or 0) <= SENT_ROWS:
        clusters = F.broadcast(clusters)
    rows = rows.withColumns({f"_s{n}": F.least(start, end), f"_e{n}": F.greatest(start, end)})
    near = (end + distance >= c_start) & (c_end >= start - distance) & (end + distance >= start - distance) & (c_end >= c_start)
    met = interval_join(clusters, rows, on=PAIR, left_span=(f"_p{n}", f"_q{n}"), right_span=(f"_s{n}", f"_e{n}"), closed=True, condition=near)
    return met.drop(f"start{n}", f"end{n}", f"_p{n}", f"_q{n}", f"_s{n}", f"_e{n}")


def _shared_clusters(pairs: DataFrame, distance: int, min_support: int, means: Sequence[str] = ()) -> DataFrame:
    """Clusters of both genes that enough reads share, with the ``means`` (of ``min_mapq`` and so on) of these reads.

    The pairs are written once, without the columns that nothing reads, and in order
    within each file, so that files and shuffles hold runs of equal genes.
    """
    spans = [f"{c}{n}" for n in (1, 2) for c in ("start", "end")]
    pairs = written(pairs.select(*PAIR, *spans, *[f"min_{m}" for m in means]).sortWithinPartitions(*PAIR, "start1"), "gene-pairs")
    rows = pairs
    for n in (1, 2):
        spots = pairs.select(*PAIR, F.col(f"start{n}").alias("start"), F.col(f"end{n}").alias("end"))
        rows = _on_clusters(rows, written(_seed_clusters(spots, PAIR, distance), "pair-clusters"), n, distance)
    found = rows.groupBy(*PAIR, "cluster1", "cluster2", "c_start1", "c_end1", "c_start2", "c_end2").agg(F.count(F.lit(1)).alias("reads"), *[F.avg(f"min_{m}").alias(f"avg_{m}") for m in means])
    return found.filter(F.col("reads") >= min_support)


def validated_fusions(pairs: DataFrame, distance: int = 100, min_support: int = VALIDATED_SUPPORT) -> DataFrame:
    """Breakpoint clusters of both genes that enough reads share.

    A read counts for every cluster with a member within ``distance`` of it,
    which is the same as touching the padded span of the cluster.
    """
    return _shared_clusters(pairs, distance, min_support, ("mapq", "span"))


def coordinate_clusters(pairs: DataFrame, distance: int = 10_000, min_support: int = VALIDATED_SUPPORT) -> DataFrame:
    """The wide-radius variant on whole alignments, without quality means."""
    return _shared_clusters(pairs, distance, min_support)


def simple_gene_pairs(candidates: DataFrame, min_support: int = VALIDATED_SUPPORT) -> DataFrame:
    """Gene pairs by distinct reads, without any breakpoint check."""
    pairs = gene_pairs_per_read(candidates).groupBy("sample_id", "gene1", "gene2").agg(F.count(F.lit(1)).alias("reads"))
    return pairs.filter(F.col("reads") >= min_support)


# --- breakpoint pairs of primary and supplementary places ---------------------


def breakpoint_candidates(gated: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alignments on the regions, and the places their SA text names."""
    panel = on_panel(gated, regions).distinct()
    return panel.drop("sa"), named_places(panel)


def on_panel(gated: DataFrame, regions: DataFrame) -> DataFrame:
    """Alignments with their SA text, once per region that they overlap."""
    cols = [*READ, "chrom", "ref_start", "ref_end", "strand", "mapq", "mapping_span", "sa"]
    return interval_join(gated.select(*cols), regions.select("chrom", "start_pos", "end_pos"), min_overlap=MIN_OVERLAP).select(*cols)


def named_places(rows: DataFrame) -> DataFrame:
    """The places that the SA text of each row names."""
    return supplementary_spans(rows.select(*READ, "sa")).select(
        *READ, F.col("sa_chrom").alias("chrom"), F.col("sa_start").alias("ref_start"), F.col("sa_end").alias("ref_end"), F.col("sa_strand").alias("strand"),
        F.col("sa_mapq").alias("mapq"), (F.col("sa_end") - F.col("sa_start")).alias("mapping_span"),
    )


def breakpoint_pairs(primary: DataFrame, supplementary: DataFrame) -> DataFrame:
    """Primary with supplementary places of each read; equal rows become one with a count."""
    def side(df, p):
        cols = {"chrom": "chrom", "ref_start": "start", "ref_end": "end", "strand": "strand", "mapq": "mapq", "mapping_span": "span"}
        named = df.select(*READ, *[F.col(c).alias(f"{p}_{a}") for c, a in cols.items()])
        return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias(f"_{p}"))

    pairs = side(primary, "p").join(side(supplementary, "s"), READ)
    return pairs.withColumn("n", F.col("_p") * F.col("_s")).drop("_p", "_s")


def cluster_canonical(primary: DataFrame, supplementary: DataFrame, bin_size: int = 500, min_support: int = READ_SUPPORT) -> DataFrame:
    """Binned endpoint pairs with enough distinct reads.

    Endpoints are binned and made distinct per read before they are paired, so
    repeated alignments of a read do not multiply.
    """
    pairs = cluster_reads(primary, supplementary, bin_size)
    key = [c for c in pairs.columns if c != "read_id"]
    out = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("reads")).filter(F.col("reads") >= min_support)
    return out.withColumns({"p_end": F.col("p_start") + bin_size, "s_end": F.col("s_start") + bin_size})


def binned_spot(bin_size: int = 500) -> Column:
    """Chromosome, bin of the midpoint and strand of an alignment."""
    mid = F.expr("(ref_start + ref_end) div 2")
    return F.struct("chrom", (mid - mid % bin_size).alias("pos"), "strand")


def cluster_reads(primary: DataFrame, supplementary: DataFrame, bin_size: int = 500) -> DataFrame:
    """Distinct ordered endpoint bins of each read."""
    def side(df, name):
        return df.select(*READ, binned_spot(bin_size).alias(name)).distinct()

    pairs = side(primary, "x").join(side(supplementary, "y"), READ).select(*READ, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    names = [F.col(f"{e}.{c}").alias(f"{p}_{n}") for e, p in (("a", "p"), ("b", "s")) for c, n in (("chrom", "chrom"), ("pos", "start"), ("strand", "strand"))]
    return pairs.select(*READ, *names)


#: Cells along each side of a tile, within which adjacent cells of a density clustering meet in one task.
CELLS_OF_TILE = 8
#: Points for each of which the comparison of adjacent cells gets one task.
TASK_POINTS = 500_000


def dbscan_labels(points: DataFrame, keys: Sequence[str], eps2: int, min_points: int) -> DataFrame:
    """Exact density clusters of weighted integer points ``x, y`` in the Manhattan metric.

    With ``u = x + y`` and ``v = x - y`` the metric becomes the larger of both
    differences, so a square cell of side ``eps2`` holds only mutual neighbours:

    * a cell of at least ``min_points`` is core as a whole, its points are never
      compared with each other;
    * only the few points of thinner cells are compared, with adjacent cells;
    * cells are linked by extremes (side by side) or by one sweep over their
      frontiers (diagonal), and connected components run on cells.

    Returns ``keys, x, y, label``; noise is left out. A border point takes the
    smallest label around it.
    """
    keys = list(keys)
    side = eps2 + 1
    pts = points.groupBy(*keys, "x", "y").agg(F.sum("w").alias("w")).withColumns({"u": F.col("x") + F.col("y"), "v": F.col("x") - F.col("y")})
    pts = pts.withColumns({"cu": F.floor(F.col("u") / side), "cv": F.floor(F.col("v") / side)})
    cell = [*keys, "cu", "cv"]
    weights = pts.groupBy(*cell).agg(F.sum("w").alias("cw"))
    placed = cut_lineage(pts.join(weights, cell))
    pts = placed.drop("cw")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    tile = [F.floor(F.col(c) / CELLS_OF_TILE).alias(t) for c, t in (("cu", "tu"), ("cv", "tv"))]
    at_tile = [*keys, "tu", "tv"]
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(placed.count() / TASK_POINTS))

    def neighbours(centre: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs of adjacent cells. Points go to the tiles that their nine cells lie in, mostly one, and the cells are listed there."""
        cells = F.transform(around, lambda d: F.struct((F.col("cu") + d["a"]).alias("cu"), (F.col("cv") + d["b"]).alias("cv")))
        tiles = F.array_distinct(F.transform(around, lambda d: F.struct(F.floor((F.col("cu") + d["a"]) / CELLS_OF_TILE).alias("tu"), F.floor((F.col("cv") + d["b"]) / CELLS_OF_TILE).alias("tv"))))
        dealt = centre.select(*keys, "x", "y", "cu", "cv", F.explode(tiles).alias("_t")).select(*keys, "_t.*", "x", "y", "cu", "cv").repartition(tasks, *at_tile)
        moved = dealt.select(*at_tile, "x", "y", F.explode(cells).alias("_c")).select(*at_tile, "x", "y", "_c.*")
        moved = moved.filter((F.floor(F.col("cu") / CELLS_OF_TILE) == F.col("tu")) & (F.floor(F.col("cv") / CELLS_OF_TILE) == F.col("tv")))
        moved = moved.withColumns({"u": F.col("x") + F.col("y"), "v": F.col("x") - F.col("y")})
        far = others.select(*keys, *tile, *[F.col(c).alias(c if c in cell else f"o_{c}") for c in others.columns if c not in keys]).repartition(tasks, *at_tile)
        near = (F.abs(F.col("u") - F.col("o_u")) <= eps2) & (F.abs(F.col("v") - F.col("o_v")) <= eps2)
        return moved.join(far.hint("merge"), [*at_tile, "cu", "cv"]).filter(near)

    thin = placed.filter(F.col("cw") < min_points)
    dense = placed.filter(F.col("cw") >= min_points).drop("cw")
    counted = neighbours(thin, pts.select(*cell, "u", "v", "w")).groupBy(*keys, "x", "y").agg(F.sum("o_w").alias("near"))
    # Thin points are compared once; both kinds of them are read from what was found.
    with dealt_by_some_keys(points.sparkSession):
        checked = cut_lineage(thin.drop("cw").join(counted, [*keys, "x", "y"]).withColumn("core", F.col("near") >= min_points).drop("near"))
    thin_core = checked.filter("core").drop("core")
    border = checked.filter("NOT core").drop("core")
    core = cut_lineage(dense.unionByName(thin_core))

    boxes = core.groupBy(*cell).agg(
        F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.min(F.struct("x", "y")).alias("first")
    )
    half = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (1, 1), (1, -1))])
    moved = boxes.drop("first").withColumn("_d", F.explode(half))
    moved = moved.select(
        *keys, F.col("cu").alias("cu_a"), F.col("cv").alias("cv_a"), (F.col("cu") + F.col("_d.a")).alias("cu"), (F.col("cv") + F.col("_d.b")).alias("cv"),
        F.col("_d.a").alias("da"), F.col("_d.b").alias("db"), *[F.col(c).alias(f"a_{c}") for c in ("u0", "u1", "v0", "v1")],
    )
    adjacent = moved.join(boxes.drop("first"), cell)
    close_u = F.when(F.col("da") == 0, True).otherwise(F.col("u0") - F.col("a_u1") <= eps2)
    close_v = F.when(F.col("db") == 0, True).when(F.col("db") == 1, F.col("v0") - F.col("a_v1") <= eps2).otherwise(F.col("a_v0") - F.col("v1") <= eps2)
    possible = adjacent.filter(close_u & close_v).select(*keys, "cu_a", "cv_a", "cu", "cv", "da", "db")
    straight = possible.filter("da = 0 OR db = 0")
    diagonal = possible.filter("da <> 0 AND db <> 0")
    # frontier of the lower cell: highest v per u; of the upper cell: lowest v per u
    pair = [*keys, "cu_a", "cv_a", "cu", "cv"]
    low = core.withColumnsRenamed({"cu": "cu_a", "cv": "cv_a"}).join(diagonal, [*keys, "cu_a", "cv_a"])
    low = low.groupBy(*pair, "db", (F.col("u") + eps2).alias("at")).agg(F.max(F.col("v") * F.col("db")).alias("reach"))
    high = core.join(diagonal, cell).groupBy(*pair, "db", F.col("u").alias("at")).agg(F.min(F.col("v") * F.col("db")).alias("floor"))
    both = low.withColumn("floor", F.lit(None).cast("bigint")).unionByName(high.withColumn("reach", F.lit(None).cast("bigint")))
    upto = Window.partitionBy(*pair).orderBy("at", F.col("floor").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("best", F.min("floor").over(upto)).filter(F.col("reach").isNotNull() & (F.col("best") <= F.col("reach") + eps2))
    links = straight.select(*pair).unionByName(met.select(*pair).distinct())
    a, b = F.struct(F.col("cu_a").alias("i"), F.col("cv_a").alias("j")), F.struct(F.col("cu").alias("i"), F.col("cv").alias("j"))
    loops = boxes.select(*keys, F.struct(F.col("cu").alias("i"), F.col("cv").alias("j")).alias("a"))
    edges = links.select(*keys, a.alias("a"), b.alias("b")).unionByName(loops.withColumn("b", F.col("a")))
    parts = connected_components(cut_lineage(edges), "a", "b", keys)
    parts = parts.select(*keys, F.col("vertex.i").alias("cu"), F.col("vertex.j").alias("cv"), "component")
    names = boxes.select(*cell, "first").join(parts, cell).groupBy(*keys, "component").agg(F.min("first").alias("label"))
    labelled = core.join(parts, cell).join(names, [*keys, "component"]).select(*cell, "x", "y", "u", "v", "label")
    labelled = written(labelled, "labels")
    edge_labels = neighbours(border, labelled.select(*cell, "u", "v", "label")).groupBy(*keys, "x", "y").agg(F.min("o_label").alias("label"))
    with dealt_by_some_keys(points.sparkSession):
        edge_labels = written(edge_labels, "edge-labels")
    return labelled.select(*keys, "x", "y", "label").unionByName(edge_labels)


def cluster_dbscan(pairs: DataFrame, distance: int = 5000, min_support: int = READ_SUPPORT) -> DataFrame:
    """Density clusters of breakpoint pairs per chromosome pair, whatever their number.

    Midpoints may end in .5, so coordinates and the radius ``1.5 * distance`` are
    doubled.
    """
    keys = ["sample_id", "p_chrom", "s_chrom"]
    pairs = keep(pairs)
    rows = pairs.withColumns({"x": F.col("p_start") + F.col("p_end"), "y": F.col("s_start") + F.col("s_end")})
    labels = dbscan_labels(rows.select(*keys, "x", "y", F.col("n").alias("w")), keys, 3 * distance, min_support)
    hit = rows.join(labels, [*keys, "x", "y"])
    group = [*keys, "label"]

    def mean(c):
        return (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"{c}_mean")

    stats = hit.groupBy(*group).agg(
        F.min("p_start").alias("p_start"), F.max("p_end").alias("p_end"), F.min("s_start").alias("s_start"), F.max("s_end").alias("s_end"),
        *[mean(c) for c in ("p_mapq", "p_span", "s_mapq", "s_span")],
    )
    reads = hit.select(*group, "read_id").distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("reads"))
    return stats.join(reads, group).filter(F.col("reads") >= min_support).drop("label")


def master_bed_events(primary: DataFrame, supplementary: DataFrame, distance: int = 5000, min_support: int = READ_SUPPORT, min_mapq: int = 50) -> DataFrame:
    """Both ends of every breakpoint cluster as events, near ones merged."""
    clusters = cluster_dbscan(breakpoint_pairs(primary, supplementary.filter(F.col("mapq") >= min_mapq)), distance, min_support)

    def end(p, kind):
        return F.struct(
            F.col(f"{p}_chrom").alias("chrom"), F.col(f"{p}_start").alias("start_pos"), F.col(f"{p}_end").alias("end_pos"), F.lit(kind).alias("event_type"),
            F.bround(f"{p}_mapq_mean", 1).alias("avg_mapq"), F.bround(f"{p}_span_mean", 0).alias("avg_span"),
        )

    ends = F.array(end("p", "breakpoint_pair_primary"), end("s", "breakpoint_pair_supplementary"))
    events = clusters.select("sample_id", F.col("reads").alias("read_count"), F.explode(ends).alias("e")).select("sample_id", "read_count", "e.*")
    events = events.filter("start_pos > 0 AND end_pos > start_pos")
    return merge_nearby(events, ["sample_id", "chrom", "event_type"], distance)


class OpenRegions:
    """The greedy clusters of one stretch that later regions can still join, in the order they were opened."""

    def __init__(self, distance: int):
        self.distance, self.open = distance, []

    def joined(self, start: int, end: int) -> str:
        """The name of the cluster that takes this region; regions come by (start, end).

        A cluster takes a region that overlaps its span, has both ends near the span's, or
        its midpoint near the span's; the first that does grows by it. A region that no
        cluster takes opens one. A cluster further left than ``distance`` takes nothing any
        more, so only neighbours within one distance are ever held.
        """
        self.open = [c for c in self.open if start <= c[1] + self.distance]
        for cluster in self.open:
            lo, hi, name = cluster
            ends = abs(lo - start) <= self.distance and abs(hi - end) <= self.distance
            if start <= hi or ends or abs((lo + hi) // 2 - (start + end) // 2) <= self.distance:
                cluster[1] = max(hi, end)
                return name
        self.open.append([start, end, f"{start}-{end}"])
        return self.open[-1][2]


def stretches_of(spots: DataFrame, keys: Sequence[str], distance: int, tile: int = TILE) -> DataFrame:
    """Distinct regions with the start of their stretch: what starts more than ``distance`` after the end of everything before it opens one.

    Regions are marked in order within tiles of a chromosome, which know of the tiles
    before them how far these reach. A region before the first new stretch of its tile
    is in the last one opened in the tiles before, which only such regions look up.
    """
    tiled = [*keys, "_tile"]
    spots = spots.withColumn("_tile", F.floor(F.col("start_pos") / tile))
    in_order = Window.partitionBy(*tiled).orderBy("start_pos", "end_pos")
    earlier = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    reach = spots.groupBy(*tiled).agg(F.max("end_pos").alias("_z")).withColumn("_reach", F.max("_z").over(earlier)).drop("_z")
    near = spots.withColumn("_here", F.max("end_pos").over(in_order.rowsBetween(Window.unboundedPreceding, -1))).join(reach, tiled)
    before = F.greatest("_here", "_reach")
    opens = F.when(before.isNull() | (F.col("start_pos") > before + distance), F.col("start_pos"))
    marked = written(near.withColumn("stretch", F.max(opens).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).drop("_here", "_reach"), "stretches")
    opened = marked.groupBy(*tiled).agg(F.max("stretch").alias("_last")).withColumn("_open", F.max("_last").over(earlier)).drop("_last")
    carried = marked.filter("stretch IS NULL").join(opened, tiled).withColumn("stretch", F.col("_open")).drop("_open")
    return marked.filter("stretch IS NOT NULL").unionByName(carried).drop("_tile")


def cluster_regions(rows: DataFrame, distance: int = 200) -> DataFrame:
    """Greedy merge of regions per chromosome with a growing cluster span.

    ``rows`` holds one line per region and read and is written once; what is averaged
    per region goes with the distinct regions from then on. A region can only join a
    cluster that starts within ``distance`` of everything before it, so the merge is
    bound to the order within connected stretches of distinct regions only: they pass
    in sorted order, and a task holds no more of a stretch than the clusters still open.
    """
    keys = ["sample_id", "chrom"]
    rows = written(rows.filter("start_pos <= end_pos"), "regions")
    region = [*keys, "start_pos", "end_pos"]
    spots = stretches_of(rows.groupBy(*region).agg(F.avg("mapq").alias("q"), F.avg("mapping_span").alias("s")), keys, distance)

    def passed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, regions = None, OpenRegions(distance)
        for pdf in pdfs:
            names = []
            for sample, chrom, stretch, start, end in pdf[[*keys, "stretch", "start_pos", "end_pos"]].itertuples(index=False, name=None):
                if (sample, chrom, stretch) != here:
                    here, regions = (sample, chrom, stretch), OpenRegions(distance)
                names.append(regions.joined(start, end))
            yield pdf[[*region, "q", "s"]].assign(cluster=names)

    ordered = spots.repartition(*keys, "stretch").sortWithinPartitions(*keys, "stretch", "start_pos", "end_pos")
    owners = written(ordered.mapInPandas(passed, "sample_id string, chrom string, start_pos long, end_pos long, q double, s double, cluster string"), "owners")
    group = [*keys, "cluster"]
    stats = owners.groupBy(*group).agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.round(F.round(F.avg("q"), 6), 1).alias("avg_mapq"), F.round(F.round(F.avg("s"), 6), 0).alias("avg_span")
    )
    hit = rows.select(*region, "read_id").join(owners.select(*region, "cluster"), region)
    reads = hit.select(*group, "read_id").distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("reads"))
    return stats.join(reads, group)
