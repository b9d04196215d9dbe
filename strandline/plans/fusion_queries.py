"""Fusion queries on the given tables."""

from pyspark.sql import functions as F

from strandline.functions.tiers import coordinates_similar, overlap_fraction, positions_close
from strandline.operators import fusion as fu
from strandline.operators.graph import connected_components
from strandline.operators.qc import qs_filter
from strandline.plans.registry import query
from strandline.session import written
from strandline.sinks.layouts import candidate_counts

FAILING = """failing AS (SELECT DISTINCT sample_id, read_id FROM alignments WHERE NOT is_secondary AND NOT is_supplementary AND qs < 12),
  fine AS (SELECT * FROM alignments a WHERE NOT EXISTS (SELECT 1 FROM failing f WHERE f.sample_id = a.sample_id AND f.read_id = a.read_id))"""
GATED = f"""{FAILING}, gated AS (SELECT *, ref_end - ref_start AS mapping_span FROM fine WHERE NOT is_unmapped AND NOT is_secondary AND sa IS NOT NULL AND chrom <> 'chrM' AND mapq > 49 AND ref_end - ref_start > 249)"""
CAND = f"""{GATED}, cand AS (SELECT a.sample_id, g.region_type AS candidate_type, a.read_id, g.name AS gene, g.start_pos AS gene_start, g.end_pos AS gene_end, a.chrom, a.ref_start, a.ref_end, a.mapq, a.strand,
  a.read_start, a.read_end, a.is_secondary, a.is_supplementary, a.mapping_span FROM gated a JOIN regions g ON a.chrom = g.chrom AND least(a.ref_end, g.end_pos) - greatest(a.ref_start, g.start_pos) > 99)"""
ARTIFACT = f"""{CAND}, rowsd AS (SELECT *, row_number() OVER (ORDER BY sample_id, read_id, chrom, ref_start, ref_end, gene, gene_start) AS rid FROM
    (SELECT DISTINCT sample_id, read_id, chrom, ref_start, ref_end, gene, gene_start, gene_end FROM cand)),
  art AS (SELECT DISTINCT a.sample_id, a.read_id FROM rowsd a JOIN rowsd b ON a.sample_id = b.sample_id AND a.read_id = b.read_id AND a.chrom = b.chrom AND a.rid < b.rid
    AND abs(a.ref_start - b.ref_start) <= 50 AND abs(a.ref_end - b.ref_end) <= 50),
  clean AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM art WHERE art.sample_id = c.sample_id AND art.read_id = c.read_id))"""
TAGS = f"""{ARTIFACT}, rt AS (SELECT sample_id, read_id, string_agg(gene, ',' ORDER BY gene) AS tag, count(*) AS n FROM (SELECT DISTINCT sample_id, read_id, gene FROM clean) GROUP BY 1, 2 HAVING count(*) > 1),
  tags AS (SELECT sample_id, tag, count(*) AS reads FROM rt GROUP BY 1, 2 HAVING count(*) >= 3),
  good AS (SELECT c.*, rt.tag FROM clean c JOIN rt USING (sample_id, read_id) WHERE EXISTS (SELECT 1 FROM tags t WHERE t.sample_id = rt.sample_id AND t.tag = rt.tag))"""


def candidates(v):
    return fu.fusion_candidates(fu.fusion_gate(qs_filter(v.alignments)), v.regions, fu.tasks_for(v.alignments))


def clean(v):
    return fu.without_artifacts(candidates(v))


@query("FLT3_fusion_gate", f"WITH {GATED} SELECT sample_id, read_id, chrom, ref_start, ref_end, mapq, mapping_span FROM gated")
def fusion_gate(v):
    return fu.fusion_gate(qs_filter(v.alignments)).select("sample_id", "read_id", "chrom", "ref_start", "ref_end", "mapq", "mapping_span")


@query("AGG27_overlap_artifacts", f"WITH {ARTIFACT} SELECT * FROM art")
def overlap_artifacts(v):
    return fu.overlap_artifacts(candidates(v))


@query(
    "AGG25_multi_gene_reads",
    f"WITH {ARTIFACT} SELECT c.* FROM clean c JOIN (SELECT sample_id, read_id FROM clean GROUP BY 1, 2 HAVING count(DISTINCT gene) > 1) m USING (sample_id, read_id)",
)
def multi_gene_reads(v):
    return fu.multi_gene_reads(clean(v))


@query("AGG26_gene_tags", f"WITH {TAGS} SELECT * FROM tags")
def gene_tags(v):
    return fu.gene_tags(clean(v))


@query("AGG30_fusion_breakpoints", f"""WITH {TAGS} SELECT DISTINCT sample_id, chrom, gene, candidate_type AS source, ref_start, ref_end, greatest(0, (ref_start + ref_end) // 2 - 10000) AS start_pos,
       (ref_start + ref_end) // 2 + 10000 AS end_pos FROM good""")
def fusion_breakpoints(v):
    return fu.fusion_breakpoints(clean(v))


COMPONENTS = f"""WITH RECURSIVE {TAGS}, edges AS (SELECT sample_id, string_split(tag, ',')[1] AS a, string_split(tag, ',')[2] AS b FROM tags WHERE length(tag) - length(replace(tag, ',', '')) = 1),
  sym AS (SELECT sample_id, a, b FROM edges UNION SELECT sample_id, b, a FROM edges),
  reach(sample_id, vertex, other) AS (SELECT sample_id, a, a FROM sym UNION SELECT r.sample_id, r.vertex, s.b FROM reach r JOIN sym s ON s.sample_id = r.sample_id AND s.a = r.other),
  comp AS (SELECT sample_id, vertex, min(other) AS component FROM reach GROUP BY 1, 2)"""


@query("GRF1_connected_components", f"{COMPONENTS} SELECT * FROM comp")
def components(v):
    parts = F.split("tag", ",")
    tags = fu.gene_tags(clean(v)).filter(F.size(parts) == 2)
    return connected_components(tags.select("sample_id", parts[0].alias("a"), parts[1].alias("b")), "a", "b", ["sample_id"])


@query(
    "AGG35_gene_groups",
    f"""{COMPONENTS}, r AS (SELECT g.sample_id, component, count(DISTINCT read_id) AS reads FROM good g JOIN comp c ON c.sample_id = g.sample_id AND c.vertex = g.gene GROUP BY 1, 2)
        SELECT sample_id, string_agg(vertex, ',' ORDER BY vertex) AS genes, any_value(reads) AS reads FROM comp JOIN r USING (sample_id, component) WHERE reads >= 3 GROUP BY sample_id, component""",
)
def gene_groups(v):
    return fu.gene_groups(clean(v))


@query("AGG36_fusion_counts", f"WITH {CAND} SELECT sample_id, candidate_type, count(*) AS rows FROM cand GROUP BY 1, 2")
def fusion_counts(v):
    return fu.fusion_counts(candidates(v))


@query(
    "AGG36_fusion_funnel",
    f"""WITH {TAGS} SELECT sample_id, '1_alignments' AS stage, count(*) AS rows FROM alignments GROUP BY 1 UNION ALL SELECT sample_id, '2_quality', count(*) FROM fine GROUP BY 1 UNION ALL SELECT sample_id, '3_gated', count(*) FROM gated GROUP BY 1
        UNION ALL SELECT sample_id, '4_candidates', count(*) FROM cand GROUP BY 1 UNION ALL SELECT sample_id, '5_without_artifacts', count(*) FROM clean GROUP BY 1
        UNION ALL SELECT c.sample_id, '6_multi_gene', count(*) FROM clean c JOIN rt USING (sample_id, read_id) GROUP BY 1 UNION ALL SELECT sample_id, '7_supported', count(*) FROM good GROUP BY 1""",
)
def fusion_funnel(v):
    return fu.fusion_funnel(v.alignments, v.regions)


@query(
    "FLT12_validate_fusion",
    f"""WITH {CAND}, s AS (SELECT sample_id, read_id, count(DISTINCT gene) AS g FROM cand GROUP BY 1, 2), p AS (SELECT sample_id, gene, count(DISTINCT read_id) AS support FROM cand GROUP BY 1, 2),
        x AS (SELECT a.sample_id, a.read_id, a.mapq, a.ref_end - a.ref_start AS mapping_span, g.name AS gene, sa IS NOT NULL AS has_sa, least(a.ref_end, g.end_pos) - greatest(a.ref_start, g.start_pos) AS overlap
              FROM alignments a JOIN regions g ON a.chrom = g.chrom AND least(a.ref_end, g.end_pos) - greatest(a.ref_start, g.start_pos) > 0)
        SELECT reason, reason = 'passed' AS valid, count(*) AS n FROM (SELECT CASE WHEN NOT has_sa THEN 'no_supplementary' WHEN coalesce(g, 0) < 2 THEN 'single_gene' WHEN mapq <= 49 THEN 'mapping_quality'
          WHEN mapping_span <= 249 THEN 'mapping_span' WHEN overlap < 99 THEN 'gene_overlap' WHEN coalesce(support, 0) < 3 THEN 'read_support' ELSE 'passed' END AS reason
          FROM x LEFT JOIN s USING (sample_id, read_id) LEFT JOIN p USING (sample_id, gene)) GROUP BY 1, 2""",
)
def validate_fusion(v):
    from strandline.operators.intervals import interval_join, overlap_length

    cand = candidates(v)
    multi = cand.groupBy("sample_id", "read_id").agg(F.min("gene").alias("_a"), F.max("gene").alias("_z")).select("sample_id", "read_id", (F.col("_a") != F.col("_z")).alias("_m"))
    support = cand.select("sample_id", "gene", "read_id").distinct().groupBy("sample_id", "gene").agg(F.count(F.lit(1)).alias("_n"))
    rows = v.alignments.select("sample_id", "read_id", "chrom", "ref_start", "ref_end", "mapq", "sa")
    hits = interval_join(rows, v.regions.select("chrom", "start_pos", "end_pos", F.col("name").alias("gene")))
    facts = hits.join(multi, ["sample_id", "read_id"], "left").join(support, ["sample_id", "gene"], "left").withColumns({
        "has_sa": F.col("sa").isNotNull(), "multi_gene": F.coalesce("_m", F.lit(False)), "mapping_span": F.col("ref_end") - F.col("ref_start"),
        "overlap": overlap_length(), "support": F.coalesce("_n", F.lit(0)),
    })
    return fu.validate_fusion(facts).groupBy("reason", "valid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "FLT16_search_reads",
    f"""WITH {TAGS}, ids AS (SELECT DISTINCT sample_id, read_id FROM good) SELECT candidate_type, count(*) AS rows, count(DISTINCT concat(sample_id, '/', read_id)) AS reads
        FROM cand c WHERE EXISTS (SELECT 1 FROM ids WHERE ids.sample_id = c.sample_id AND ids.read_id = c.read_id) GROUP BY 1""",
)
def search_reads(v):
    return fu.search_reads(candidates(v), fu.supported_rows(clean(v)))


@query(
    "JN18_new_reads_only",
    f"WITH {CAND} SELECT sample_id, read_id, gene, ref_start, ref_end FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand p WHERE p.candidate_type = 'target' AND p.sample_id = c.sample_id AND p.read_id = c.read_id)",
)
def new_reads_only(v):
    rows = candidates(v)
    return fu.new_reads_only(rows, rows.filter("candidate_type = 'target'")).select("sample_id", "read_id", "gene", "ref_start", "ref_end")


@query(
    "SET5_reads_with_both",
    "SELECT DISTINCT sample_id, read_id FROM alignments a WHERE NOT is_supplementary AND NOT is_secondary AND EXISTS (SELECT 1 FROM alignments b WHERE b.is_supplementary AND b.sample_id = a.sample_id AND b.read_id = a.read_id)",
)
def reads_with_both(v):
    rows = v.alignments
    return fu.reads_with_both(rows.filter("NOT is_supplementary AND NOT is_secondary"), rows.filter("is_supplementary"))


@query(
    "SET6_new_tags",
    f"""WITH {TAGS}, early AS (SELECT sample_id, tag FROM rt WHERE CAST(substr(read_id, 2) AS BIGINT) * 2 < (SELECT max(CAST(substr(read_id, 2) AS BIGINT)) FROM rt) GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT sample_id, tag FROM tags t WHERE NOT EXISTS (SELECT 1 FROM early e WHERE e.sample_id = t.sample_id AND e.tag = t.tag)""",
)
def new_tags(v):
    tags = fu.read_tags(clean(v)).withColumn("_n", F.substring("read_id", 2, 20).cast("bigint"))
    half = tags.agg(F.max("_n").alias("_max"))
    valid = tags.groupBy("sample_id", "tag").agg(F.count(F.lit(1)).alias("reads")).filter("reads >= 3")
    early = tags.filter(F.col("_n") * 2 < half.scalar()).groupBy("sample_id", "tag").agg(F.count(F.lit(1)).alias("reads")).filter("reads >= 3")
    return fu.new_tags(valid, early)


PICK = f"""{ARTIFACT}, pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, read_id, gene ORDER BY ref_start, ref_end, chrom, strand, mapq, mapping_span) AS k FROM clean) WHERE k = 1),
  gp AS (SELECT a.sample_id, a.read_id, a.gene AS gene1, a.chrom AS chr1, a.ref_start AS start1, a.ref_end AS end1, a.strand AS strand1, b.gene AS gene2, b.chrom AS chr2, b.ref_start AS start2, b.ref_end AS end2, b.strand AS strand2,
    least(a.mapq, b.mapq) AS min_mapq, least(a.mapping_span, b.mapping_span) AS min_span FROM pick a JOIN pick b ON a.sample_id = b.sample_id AND a.read_id = b.read_id AND a.gene < b.gene)"""


@query("WIN18_gene_alignment_pick", f"WITH {PICK} SELECT sample_id, read_id, gene, ref_start, ref_end, chrom, strand, mapq, mapping_span FROM pick")
def gene_alignment_pick(v):
    return fu.gene_alignment_pick(clean(v))


@query("JN17_gene_pairs_per_read", f"WITH {PICK} SELECT * FROM gp")
def gene_pairs_per_read(v):
    return fu.gene_pairs_per_read(clean(v))


@query(
    "FNC_similarity",
    f"""WITH {PICK} SELECT sample_id, read_id, gene1, gene2, abs(start1 - start2) <= 5000 AND abs(end1 - end2) <= 5000 AS similar,
        least(abs(start1 - start2), abs(end1 - end2), abs(start1 - end2), abs(end1 - start2)) <= 1000 AS close,
        greatest(0, least(end1, end2) - greatest(start1, start2)) * 1.0E0 / least(end1 - start1, end2 - start2) AS shared FROM gp""",
)
def similarity(v):
    """How alike the two places of each gene pair are, whatever their chromosomes."""
    at = [F.col(c) for c in ("start1", "end1", "start2", "end2")]
    rows = fu.gene_pairs_per_read(clean(v))
    return rows.select("sample_id", "read_id", "gene1", "gene2", coordinates_similar(*at, distance=5000).alias("similar"), positions_close(*at, distance=1000).alias("close"), overlap_fraction(*at).alias("shared"))


@query("JN17_simple_gene_pairs", f"WITH {PICK} SELECT sample_id, gene1, gene2, count(*) AS reads FROM gp GROUP BY 1, 2, 3 HAVING count(*) >= 4")
def simple_gene_pairs(v):
    return fu.simple_gene_pairs(clean(v))


HIT_PAIRS = PICK[PICK.index("pick AS"):].replace("FROM clean", "FROM fusion_hits")


def _chain(n: int, d: int) -> str:
    """SQL text of the seed chain of one side: a recursive walk from seed to seed."""
    g = "sample_id, gene1, gene2, chr1, chr2"
    return f"""pos{n} AS (SELECT {g}, start{n} AS s, min(end{n}) AS e, max(end{n}) AS z FROM gp GROUP BY ALL),
  walk{n} AS (SELECT {g}, min(s) AS s, arg_min(e, s) AS e, 0 AS k FROM pos{n} GROUP BY ALL
    UNION ALL SELECT {g}, s, e, k FROM (SELECT p.sample_id, p.gene1, p.gene2, p.chr1, p.chr2, min(p.s) AS s, arg_min(p.e, p.s) AS e, any_value(w.k) + 1 AS k
      FROM walk{n} w JOIN pos{n} p ON p.sample_id = w.sample_id AND p.gene1 = w.gene1 AND p.gene2 = w.gene2 AND p.chr1 = w.chr1 AND p.chr2 = w.chr2 AND p.s > w.e + {d} GROUP BY 1, 2, 3, 4, 5)),
  cl{n} AS (SELECT w.sample_id, w.gene1, w.gene2, w.chr1, w.chr2, w.k AS cluster{n}, w.s AS c_start{n}, max(p.z) AS c_end{n} FROM walk{n} w
    JOIN pos{n} p ON p.sample_id = w.sample_id AND p.gene1 = w.gene1 AND p.gene2 = w.gene2 AND p.chr1 = w.chr1 AND p.chr2 = w.chr2 AND p.s BETWEEN w.s AND w.e + {d} GROUP BY 1, 2, 3, 4, 5, 6, 7)"""


def _validated(d: int, quality: str) -> str:
    """SQL text of the shared clusters, on the dense hits."""
    on = "r.sample_id = {c}.sample_id AND r.gene1 = {c}.gene1 AND r.gene2 = {c}.gene2 AND r.chr1 = {c}.chr1 AND r.chr2 = {c}.chr2"
    return f"""WITH RECURSIVE {HIT_PAIRS}, {_chain(1, d)}, {_chain(2, d)}
      SELECT r.sample_id, r.gene1, r.gene2, r.chr1, r.chr2, cluster1, cluster2, c_start1, c_end1, c_start2, c_end2, count(*) AS reads{quality} FROM gp r
      JOIN cl1 ON {on.format(c='cl1')} AND c_start1 <= r.end1 + {d} AND c_end1 >= r.start1 - {d} JOIN cl2 ON {on.format(c='cl2')} AND c_start2 <= r.end2 + {d} AND c_end2 >= r.start2 - {d}
      GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11 HAVING count(*) >= 4"""


@query("AGG32_validated_fusions", _validated(100, ", avg(min_mapq) AS avg_mapq, avg(min_span) AS avg_span"))
def validated_fusions(v):
    return fu.validated_fusions(fu.gene_pairs_per_read(v.fusion_hits))


@query("AGG33_coordinate_clusters", _validated(10000, ""))
def coordinate_clusters(v):
    return fu.coordinate_clusters(fu.gene_pairs_per_read(v.fusion_hits))


@query(
    "JN19_validated_groups",
    f"""{COMPONENTS}, r AS (SELECT g.sample_id, component, count(DISTINCT read_id) AS reads FROM good g JOIN comp c ON c.sample_id = g.sample_id AND c.vertex = g.gene GROUP BY 1, 2),
        pk AS (SELECT DISTINCT sample_id, read_id, gene FROM clean),
        vp AS (SELECT a.sample_id, a.gene AS gene1, b.gene AS gene2 FROM pk a JOIN pk b ON a.sample_id = b.sample_id AND a.read_id = b.read_id AND a.gene < b.gene GROUP BY 1, 2, 3 HAVING count(*) >= 4)
        SELECT sample_id, string_agg(vertex, ',' ORDER BY vertex) AS genes, any_value(reads) AS reads FROM comp JOIN r USING (sample_id, component)
        WHERE reads >= 3 AND EXISTS (SELECT 1 FROM vp JOIN comp x ON x.sample_id = vp.sample_id AND x.vertex = gene1 JOIN comp y ON y.sample_id = vp.sample_id AND y.vertex = gene2
          WHERE vp.sample_id = comp.sample_id AND x.component = comp.component AND y.component = comp.component) GROUP BY sample_id, component""",
)
def validated_groups(v):
    rows = clean(v)
    return fu.validated_groups(fu.gene_groups(rows), fu.simple_gene_pairs(rows))


PLACES = f"""{GATED}, prim AS (SELECT DISTINCT a.sample_id, a.read_id, a.chrom, a.ref_start, a.ref_end, a.strand, a.mapq, a.mapping_span, a.sa FROM gated a JOIN regions g ON a.chrom = g.chrom
    AND least(a.ref_end, g.end_pos) - greatest(a.ref_start, g.start_pos) > 99),
  parts AS (SELECT sample_id, read_id, string_split(e, ',') AS p FROM (SELECT sample_id, read_id, unnest(string_split(sa, ';')) AS e FROM prim) WHERE e <> ''),
  supp AS (SELECT sample_id, read_id, p[1] AS chrom, CAST(p[2] AS BIGINT) AS ref_start, CAST(p[2] AS BIGINT) + CASE WHEN p[4] = '*' THEN 100 ELSE CAST(regexp_extract(p[4], '^([0-9]+)M', 1) AS BIGINT) + 50 END AS ref_end,
    p[3] AS strand, CAST(p[5] AS INT) AS mapq FROM parts WHERE p[1] <> 'chrM'),
  bp AS (SELECT a.sample_id, a.read_id, a.chrom AS p_chrom, a.ref_start AS p_start, a.ref_end AS p_end, a.strand AS p_strand, a.mapq AS p_mapq, a.mapping_span AS p_span,
    b.chrom AS s_chrom, b.ref_start AS s_start, b.ref_end AS s_end, b.strand AS s_strand, b.mapq AS s_mapq, b.ref_end - b.ref_start AS s_span, count(*) AS n
    FROM (SELECT sample_id, read_id, chrom, ref_start, ref_end, strand, mapq, mapping_span FROM prim) a JOIN supp b USING (sample_id, read_id) GROUP BY ALL)"""


def places(v):
    return fu.breakpoint_candidates(fu.fusion_gate(qs_filter(v.alignments)), v.regions)


@query("JN16_breakpoint_pairs", f"WITH {PLACES} SELECT * FROM bp")
def breakpoint_pairs(v):
    return fu.breakpoint_pairs(*places(v))


@query(
    "AGG28_cluster_canonical",
    f"""WITH {PLACES}, x AS (SELECT sample_id, read_id, struct_pack(chrom := p_chrom, pos := (p_start + p_end) // 2 // 500 * 500, strand := p_strand) AS a, struct_pack(chrom := s_chrom, pos := (s_start + s_end) // 2 // 500 * 500, strand := s_strand) AS b FROM bp),
        o AS (SELECT sample_id, read_id, least(a, b) AS a, greatest(a, b) AS b FROM x)
        SELECT sample_id, a.chrom AS p_chrom, a.pos AS p_start, a.pos + 500 AS p_end, a.strand AS p_strand, b.chrom AS s_chrom, b.pos AS s_start, b.pos + 500 AS s_end, b.strand AS s_strand, count(DISTINCT read_id) AS reads
        FROM o GROUP BY sample_id, a, b HAVING count(DISTINCT read_id) >= 3""",
)
def cluster_canonical(v):
    return fu.cluster_canonical(*places(v))


K = "sample_id = {b}.sample_id AND {a}.p_chrom = {b}.p_chrom AND {a}.s_chrom = {b}.s_chrom"
DENSE = f"""WITH RECURSIVE {PLACES.replace('supp AS', 'supp_all AS').replace('bp AS', 'supp AS (SELECT * FROM supp_all {where}), bp AS')},
  pts AS (SELECT sample_id, p_chrom, s_chrom, p_start + p_end AS x, s_start + s_end AS y, sum(n) AS w FROM bp GROUP BY ALL),
  near AS (SELECT a.sample_id, a.p_chrom, a.s_chrom, a.x, a.y, b.x AS x2, b.y AS y2, b.w FROM pts a JOIN pts b ON a.{K.format(a='a', b='b')} AND abs(a.x - b.x) + abs(a.y - b.y) <= 15000),
  core AS (SELECT sample_id, p_chrom, s_chrom, x, y FROM near GROUP BY ALL HAVING sum(w) >= 3),
  link AS (SELECT n.* FROM near n JOIN core c ON n.{K.format(a='n', b='c')} AND n.x2 = c.x AND n.y2 = c.y),
  clink AS (SELECT l.* FROM link l JOIN core c ON l.{K.format(a='l', b='c')} AND l.x = c.x AND l.y = c.y),
  reach(sample_id, p_chrom, s_chrom, x, y, x2, y2) AS (SELECT sample_id, p_chrom, s_chrom, x, y, x, y FROM core
    UNION SELECT r.sample_id, r.p_chrom, r.s_chrom, r.x, r.y, l.x2, l.y2 FROM reach r JOIN clink l ON r.{K.format(a='r', b='l')} AND r.x2 = l.x AND r.y2 = l.y),
  lab AS (SELECT sample_id, p_chrom, s_chrom, x, y, min(struct_pack(x := x2, y := y2)) AS label FROM reach GROUP BY 1, 2, 3, 4, 5),
  edge AS (SELECT l.sample_id, l.p_chrom, l.s_chrom, l.x, l.y, min(b.label) AS label FROM link l JOIN lab b ON l.{K.format(a='l', b='b')} AND l.x2 = b.x AND l.y2 = b.y
    WHERE NOT EXISTS (SELECT 1 FROM core c WHERE l.{K.format(a='l', b='c')} AND l.x = c.x AND l.y = c.y) GROUP BY 1, 2, 3, 4, 5),
  labels AS (SELECT * FROM lab UNION ALL SELECT * FROM edge),
  dense AS (SELECT b.sample_id, b.p_chrom, b.s_chrom, min(p_start) AS p_start, max(p_end) AS p_end, min(s_start) AS s_start, max(s_end) AS s_end,
    sum(p_mapq * n) / sum(n) AS p_mapq_mean, sum(p_span * n) / sum(n) AS p_span_mean, sum(s_mapq * n) / sum(n) AS s_mapq_mean, sum(s_span * n) / sum(n) AS s_span_mean, count(DISTINCT read_id) AS reads
    FROM bp b JOIN labels l ON b.{K.format(a='b', b='l')} AND b.p_start + b.p_end = l.x AND b.s_start + b.s_end = l.y GROUP BY b.sample_id, b.p_chrom, b.s_chrom, label HAVING count(DISTINCT read_id) >= 3)"""


@query("AGG29_cluster_dbscan", DENSE.replace("{where}", "") + " SELECT * FROM dense")
def cluster_dbscan(v):
    return fu.cluster_dbscan(fu.breakpoint_pairs(*places(v)))


@query(
    "AGG31_master_bed_events",
    DENSE.replace("{where}", "WHERE mapq >= 50")
    + """, ev AS (SELECT sample_id, p_chrom AS chrom, p_start AS start_pos, p_end AS end_pos, 'breakpoint_pair_primary' AS event_type, reads AS read_count, round_even(p_mapq_mean, 1) AS avg_mapq, round_even(p_span_mean, 0) AS avg_span FROM dense
      UNION ALL SELECT sample_id, s_chrom, s_start, s_end, 'breakpoint_pair_supplementary', reads, round_even(s_mapq_mean, 1), round_even(s_span_mean, 0) FROM dense),
      num AS (SELECT *, row_number() OVER (ORDER BY sample_id, chrom, event_type, start_pos, end_pos, read_count, avg_mapq, avg_span) AS rn FROM ev WHERE start_pos > 0 AND end_pos > start_pos),
      fl AS (SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY sample_id, chrom, event_type ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5000 THEN 0 ELSE 1 END AS f FROM num),
      isl AS (SELECT *, sum(f) OVER (PARTITION BY sample_id, chrom, event_type ORDER BY rn ROWS UNBOUNDED PRECEDING) AS g FROM fl)
      SELECT sample_id, chrom, event_type, min(start_pos) AS start_pos, max(end_pos) AS end_pos, max(read_count) AS read_count, max(avg_mapq) AS avg_mapq, max(avg_span) AS avg_span FROM isl GROUP BY sample_id, chrom, event_type, g""",
)
def master_bed_events(v):
    return fu.master_bed_events(*places(v))


def places_in_one(v):
    """All places in one table, from alignments on the regions that are written once."""
    panel = written(fu.on_panel(fu.fusion_gate(qs_filter(v.alignments)), v.regions).distinct(), "panel")
    return panel.drop("sa").unionByName(fu.named_places(panel))


@query(
    "AGG34_cluster_regions",
    f"""WITH {PLACES}, rows_in AS (SELECT sample_id, read_id, chrom, (ref_start + ref_end) // 2 // 500 * 500 AS b, mapq, mapping_span FROM prim UNION ALL SELECT sample_id, read_id, chrom, (ref_start + ref_end) // 2 // 500 * 500, mapq, ref_end - ref_start FROM supp),
        bins AS (SELECT sample_id, chrom, b, avg(mapq) AS q, avg(mapping_span) AS s FROM rows_in GROUP BY 1, 2, 3),
        runs AS (SELECT *, b - 500 * row_number() OVER (PARTITION BY sample_id, chrom ORDER BY b) AS g FROM bins)
        SELECT r.sample_id, r.chrom, concat(CAST(min(r.b) AS VARCHAR), '-', CAST(min(r.b) + 500 AS VARCHAR)) AS cluster, min(r.b) AS start_pos, max(r.b) + 500 AS end_pos, any_value(n.reads) AS reads, round(round(avg(q), 6), 1) AS avg_mapq, round(round(avg(s), 6), 0) AS avg_span
        FROM runs r JOIN (SELECT x.sample_id, x.chrom, g, count(DISTINCT read_id) AS reads FROM rows_in x JOIN runs USING (sample_id, chrom, b) GROUP BY 1, 2, 3) n ON n.sample_id = r.sample_id AND n.chrom = r.chrom AND n.g = r.g
        GROUP BY r.sample_id, r.chrom, r.g""",
)
def cluster_regions(v):
    """Bins of 500 bases around the midpoints of all places; touching bins become one region."""
    mid = F.expr("(ref_start + ref_end) div 2")
    rows = places_in_one(v).withColumn("start_pos", mid - mid % 500)
    return fu.cluster_regions(rows.select("sample_id", "read_id", "chrom", "start_pos", (F.col("start_pos") + 500).alias("end_pos"), "mapq", "mapping_span"))


SHORT = "20 + (ref_start + ref_end) // 2 % 23 * 10"


@query(
    "AGG34_cluster_short_regions",
    f"""WITH RECURSIVE {PLACES}, rows_in AS (SELECT sample_id, read_id, chrom, (ref_start + ref_end) // 2 AS s, (ref_start + ref_end) // 2 + {SHORT} AS e, mapq, mapping_span FROM prim
          UNION ALL SELECT sample_id, read_id, chrom, (ref_start + ref_end) // 2, (ref_start + ref_end) // 2 + {SHORT}, mapq, ref_end - ref_start FROM supp),
        spots AS (SELECT DISTINCT sample_id, chrom, s, e FROM rows_in),
        marks AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY sample_id, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200, true) AS f FROM spots),
        numbered AS (SELECT *, sum(f::INT) OVER (PARTITION BY sample_id, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marks),
        placed AS (SELECT *, row_number() OVER (PARTITION BY sample_id, chrom, g ORDER BY s, e) AS i FROM numbered),
        -- region by region: the first open cluster that takes it grows, or the region opens one
        walk(sample_id, chrom, g, i, s, e, owner, open) AS (
          SELECT sample_id, chrom, g, i, s, e, concat(s::VARCHAR, '-', e::VARCHAR), [struct_pack(lo := s, hi := e, name := concat(s::VARCHAR, '-', e::VARCHAR))] FROM placed WHERE i = 1
          UNION ALL
          SELECT sample_id, chrom, g, i, s, e, coalesce(t.name, own), CASE WHEN t IS NULL THEN list_append(open, struct_pack(lo := s, hi := e, name := own))
            ELSE list_transform(open, lambda c: CASE WHEN c.name = t.name THEN struct_pack(lo := c.lo, hi := greatest(c.hi, e), name := c.name) ELSE c END) END
          FROM (SELECT p.*, w.open, concat(p.s::VARCHAR, '-', p.e::VARCHAR) AS own,
              list_filter(w.open, lambda c: p.s <= c.hi + 200 AND (p.s <= c.hi OR abs(c.lo - p.s) <= 200 AND abs(c.hi - p.e) <= 200 OR abs((c.lo + c.hi) // 2 - (p.s + p.e) // 2) <= 200))[1] AS t
            FROM walk w JOIN placed p ON p.sample_id = w.sample_id AND p.chrom = w.chrom AND p.g = w.g AND p.i = w.i + 1)),
        owned AS (SELECT r.*, w.owner FROM rows_in r JOIN walk w USING (sample_id, chrom, s, e)),
        each AS (SELECT sample_id, chrom, owner, s, e, avg(mapq) AS q, avg(mapping_span) AS m FROM owned GROUP BY ALL),
        stats AS (SELECT sample_id, chrom, owner, min(s) AS start_pos, max(e) AS end_pos, round(round(avg(q), 6), 1) AS avg_mapq, round(round(avg(m), 6), 0) AS avg_span FROM each GROUP BY ALL),
        reads AS (SELECT sample_id, chrom, owner, count(DISTINCT read_id) AS reads FROM owned GROUP BY ALL)
        SELECT sample_id, chrom, owner AS cluster, start_pos, end_pos, reads, avg_mapq, avg_span FROM stats JOIN reads USING (sample_id, chrom, owner)""",
)
def cluster_short_regions(v):
    """Regions of 20 to 240 bases at the midpoints of all places, short enough that near ends and near midpoints decide beside overlap."""
    mid = F.expr("(ref_start + ref_end) div 2")
    rows = places_in_one(v).withColumn("start_pos", mid).withColumn("end_pos", F.col("start_pos") + 20 + F.col("start_pos") % 23 * 10)
    return fu.cluster_regions(rows.select("sample_id", "read_id", "chrom", "start_pos", "end_pos", "mapq", "mapping_span"))


@query("SNK4_append_candidates", f"WITH {CAND} SELECT candidate_type, sample_id, count(*) AS rows FROM cand GROUP BY 1, 2")
def append_candidates(v):
    """Writes two batches below the shared folder and counts what was stored."""
    from strandline.session import scratch_path
    from strandline.sinks.layouts import append_candidates as append

    rows = candidates(v)
    path = scratch_path(v.spark, "candidates")
    append(rows.filter("strand = '+'"), path, batch_id=0)
    append(rows.filter("strand <> '+'"), path, batch_id=1)
    append(rows.filter("strand <> '+'"), path, batch_id=1)
    return candidate_counts(v.spark.read.parquet(path))
