"""Rules across operators: read quality, no size switches, one hot tile, arrival order, the shared folder."""

import random
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandline import session
from strandline.functions.quantiles import exact_quantiles
from strandline.operators import cnv
from strandline.operators import fusion as fu
from strandline.operators import methylation as me
from strandline.operators import qc
from strandline.operators.graph import connected_components
from strandline.operators.ranges import merge_ranges
from strandline.plans.views import Views

SF = "/root/testdata/sf0.01"
ALIGNMENT = "sample_id string, read_id string, chrom string, ref_start long, ref_end long, mapq int, strand string, is_unmapped boolean, is_secondary boolean, is_supplementary boolean, read_start long, read_end long, sa string, qs double"


def aligned(spark, reads):
    data = []
    for read, quality in reads:
        data += [("s", read, "chr1", 100, 900, 60, "+", False, False, False, 0, 800, "x", quality), ("s", read, "chr2", 100, 900, 60, "+", False, False, True, 0, 800, "x", 30.0)]
    return spark.createDataFrame(data, ALIGNMENT)


def test_a_failing_primary_removes_its_supplementary_rows(spark):
    regions = spark.createDataFrame([("chr1", 0, 1000, "A", "target"), ("chr2", 0, 1000, "B", "genome")], "chrom string, start_pos long, end_pos long, name string, region_type string")
    rows_in = aligned(spark, [("a", 20.0), ("b", 11.9), ("c", 12.0), ("d", None)])
    found = fu.fusion_candidates(fu.fusion_gate(qc.qs_filter(rows_in)), regions)
    assert rows(found, "read_id", "gene") == [(r, g) for r in "acd" for g in "AB"]
    assert rows(fu.gene_tags(found), "tag", "reads") == [("A,B", 3)]
    funnel = dict(rows(fu.fusion_funnel(rows_in, regions), "stage", "rows"))
    assert funnel == {"1_alignments": 8, "2_quality": 6, "3_gated": 6, "4_candidates": 6, "5_without_artifacts": 6, "6_multi_gene": 6, "7_supported": 6}


def test_a_hundred_thousand_pairs_of_one_chromosome_pair_are_clustered(spark):
    n = 100_500
    at = F.col("id") % 3 * 1_000_000 + F.col("id") % 97
    pairs = spark.range(n).select(
        F.lit("s").alias("sample_id"), F.concat(F.lit("r"), "id").alias("read_id"), F.lit("chr1").alias("p_chrom"), at.alias("p_start"), (at + 10).alias("p_end"), F.lit("+").alias("p_strand"), F.lit(60).alias("p_mapq"), F.lit(10).alias("p_span"),
        F.lit("chr2").alias("s_chrom"), at.alias("s_start"), (at + 10).alias("s_end"), F.lit("-").alias("s_strand"), F.lit(50).alias("s_mapq"), F.lit(10).alias("s_span"), F.lit(1).alias("n"),
    )
    got = fu.cluster_dbscan(pairs).collect()
    assert [r.reads for r in got] == [n // 3] * 3 and {r.p_mapq_mean for r in got} == {60.0} and sorted(r.p_start for r in got) == [0, 1_000_000, 2_000_000]


def test_long_chains_are_one_component(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain, "a", "b").collect()} == {0}


def test_short_tracks_stay_and_rests_count(spark):
    track = spark.createDataFrame([("s", "chr1", i, float(i)) for i in range(3)] + [("s", "chr2", i, float(i)) for i in range(10)], "sample_id string, chrom string, bin_idx long, value double")
    got = rows(cnv.downsample_mean(track, 4), "chrom", "position", "value")
    assert got == [("chr1", 5e5, 0.0), ("chr1", 1.5e6, 1.0), ("chr1", 2.5e6, 2.0), ("chr2", 2e6, 1.5), ("chr2", 6e6, 5.5), ("chr2", 9e6, 8.5)]


def test_a_share_of_rows_is_the_same_on_any_partitioning(spark):
    data = spark.range(20_000).select("id")
    one, two = (rows(cnv.random_sample(d, 0.1, ["id"]), "id") for d in (data, data.repartition(7)))
    assert one == two and 1800 < len(one) < 2200 and rows(cnv.random_sample(data, 0.1, ["id"], seed=1), "id") != one


def test_all_reads_of_a_file_count(spark):
    reads = spark.range(10_050).select(F.lit("f").alias("file"), F.format_string("r%06d", "id").alias("read_id"), F.when(F.col("id") >= 10_020, "C+m:1").alias("mm"))
    assert rows(me.has_methylation_data(reads), "total_reads", "reads_with_mm", "has_data") == [(10_050, 30, True)]


def merged(spans, slack):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + slack:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("tile", [50, 100_000])
@pytest.mark.parametrize("slack", [0, 30])
def test_ranges_merge_alike_with_any_tile(spark, tile, slack):
    rng = random.Random(tile + slack)
    spans = [(s := rng.randrange(5000), s + rng.choice([1, 20, 400])) for _ in range(120)]
    frame = spark.createDataFrame([("c", a, b) for a, b in spans], "chrom string, start_pos long, end_pos long")
    assert rows(merge_ranges(frame, ["chrom"], slack=slack, tile=tile), "start_pos", "end_pos") == merged(spans, slack)


def test_quantiles_of_one_group(spark):
    values = [(7 * i * i) % 10_007 for i in range(5000)]
    frame = spark.createDataFrame([("g", float(x)) for x in values], "k string, v double")
    got = exact_quantiles(frame, ["k"], "v", [0.25, 0.5], ["q1", "q2"]).first()
    ordered = sorted(values)
    assert (got.q1, got.q2) == tuple(ordered[int(p * 4999)] + (ordered[int(p * 4999) + 1] - ordered[int(p * 4999)]) * (p * 4999 % 1) for p in (0.25, 0.5))


def test_fusion_does_not_depend_on_arrival_order(spark):
    v = Views(spark, SF)

    def tags(alignments, regions):
        return fu.gene_tags(fu.without_artifacts(fu.fusion_candidates(fu.fusion_gate(qc.qs_filter(alignments)), regions)), 1)

    want = rows(tags(v.alignments, v.regions), "sample_id", "tag", "reads")
    shuffled = tags(v.alignments.orderBy(F.rand(3)), v.regions.orderBy(F.rand(4)))
    assert want and rows(shuffled, "sample_id", "tag", "reads") == want


def test_methylation_merge_does_not_depend_on_arrival_order(spark):
    state = Views(spark, SF).meth_rows
    cols = ["sample_id", "chrom", "pos", "mod_code", "strand", "valid_cov", "n_mod", "n_canonical"]
    assert rows(me.merge_meth_state(state), *cols) == rows(me.merge_meth_state(state.orderBy(F.rand(5))), *cols)


def test_a_cluster_must_name_a_shared_folder():
    class Fake:
        conf = SimpleNamespace(get=lambda *_: None)
        sparkContext = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")

    with pytest.raises(ValueError, match="share"):
        session.shared_dir(Fake())
