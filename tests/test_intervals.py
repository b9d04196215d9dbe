import random

from conftest import rows
from pyspark.sql import functions as F

from strandline.operators import intervals as iv
from strandline.operators import ranges as rg


def spans(spark, data, names):
    return spark.createDataFrame(data, names)


def test_overlap_must_exceed_the_minimum(spark):
    a = spans(spark, [("chr1", 0, 1000)], "chrom string, ref_start long, ref_end long")
    b = spans(spark, [("chr1", 901, 2000, "99"), ("chr1", 900, 2000, "100"), ("chr2", 0, 1000, "x"), ("chr1", 1000, 1100, "touch")], "chrom string, start_pos long, end_pos long, name string")
    assert rows(iv.interval_join(a, b, min_overlap=99), "name") == [("100",)]
    assert rows(iv.interval_join(a, b), "name") == [("100",), ("99",)]
    assert rows(iv.interval_join(a, b, closed=True), "name") == [("100",), ("99",), ("touch",)]


def test_every_pair_once_against_brute_force(spark):
    rnd = random.Random(3)

    def make(n, longest):
        out = []
        for i in range(n):
            s = rnd.randrange(0, 3000)
            out.append((f"chr{rnd.randrange(1, 3)}", s, s + rnd.randrange(0, longest), i))
        return out

    left, right = make(120, 900), make(60, 400)
    a = spans(spark, left, "chrom string, ref_start long, ref_end long, i long")
    b = spans(spark, right, "chrom string, start_pos long, end_pos long, j long")
    for closed in (False, True):
        extra = 1 if closed else 0
        want = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and min(x[2], y[2]) + extra - max(x[1], y[1]) > 0)
        assert rows(iv.interval_join(a, b, closed=closed, width=128), "i", "j") == want


def test_merge_is_the_same_over_tiles(spark):
    rnd = random.Random(5)
    data = [("chr1", s := rnd.randrange(0, 5000), s + rnd.randrange(1, 60), rnd.randrange(9)) for _ in range(150)]
    df = spans(spark, data, "chrom string, start_pos long, end_pos long, read_count long")
    for slack in (0, 7):
        want = []
        for c, s, e, n in sorted(data):
            if want and s <= want[-1][1] + slack:
                want[-1] = (want[-1][0], max(want[-1][1], e), max(want[-1][2], n))
            else:
                want.append((s, e, n))
        for tile in (64, 1 << 20):
            got = rg.merge_ranges(df, ["chrom"], slack=slack, carry={"read_count": "max"}, tile=tile)
            assert rows(got, "start_pos", "end_pos", "read_count") == want


def test_names_join_unless_contained(spark):
    data = [("chr1", 0, 10, "AB", "+"), ("chr1", 5, 20, "A", "+"), ("chr1", 20, 30, "C", "+"), ("chr1", 31, 40, "D", "+"), ("chr1", 0, 10, "E", "-")]
    out = rg.merge_overlapping(spans(spark, data, "chrom string, start_pos long, end_pos long, name string, strand string"))
    assert rows(out, "strand", "start_pos", "end_pos", "name") == [("+", 0, 30, "AB,C"), ("+", 31, 40, "D"), ("-", 0, 10, "E")]


def test_breakpoints_expand_and_clamp(spark):
    df = spans(spark, [("chr1", 5000, 50000, "n")], "chrom string, start_pos long, end_pos long, name string")
    assert rows(rg.expand_breakpoints(df), "start_pos", "end_pos", "strand") == [(0, 15000, "+"), (0, 15000, "-"), (40000, 60000, "+"), (40000, 60000, "-")]


def test_only_missing_strands_are_doubled(spark):
    df = spans(spark, [("chr1", 1, 2, "."), ("chr1", 1, 2, "-")], "chrom string, start_pos long, end_pos long, strand string")
    assert rows(rg.both_strands(df), "strand") == [("+",), ("-",), ("-",)]


def test_sort_ranks(spark):
    data = [(c, 1, 2, "+") for c in ("chrM", "chr10", "chrX", "chr2", "weird", "chrY")]
    out = rg.genomic_sort(spans(spark, data, "chrom string, start_pos long, end_pos long, strand string"))
    assert [r["chrom"] for r in out.collect()] == ["chr2", "chr10", "chrX", "chrY", "chrM", "weird"]


def test_zero_counts_stay(spark):
    al = spans(spark, [("s", "r", "chr1", 0, 10, False, False, False)], "sample_id string, read_id string, chrom string, ref_start long, ref_end long, is_unmapped boolean, is_secondary boolean, is_supplementary boolean")
    regions = spans(spark, [("chr1", 5, 20, "a"), ("chr1", 50, 60, "b")], "chrom string, start_pos long, end_pos long, name string")
    assert rows(iv.count_reads_per_target(al, regions, ["chrom", "start_pos", "end_pos", "name"]), "name", "reads") == [("a", 1), ("b", 0)]
    assert al.withColumn("x", F.lit(1)).count() == 1


def test_a_panel_is_broadcast_only_where_it_is_marked(spark):
    """A panel's file size says little about its expanded rows, so it never goes to the driver unasked."""
    spans = spark.createDataFrame([("chr1", 0, 50_000)], "chrom string, a long, b long")
    genes = spark.createDataFrame([("chr1", i, i + 10, f"g{i}") for i in range(0, 100, 20)], "chrom string, start_pos long, end_pos long, gene string")
    for join in (iv.interval_join, iv.nested_interval_join):
        plan = join(spans, genes, left_span=("a", "b"))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    marked = iv.nested_interval_join(F.broadcast(spans), genes, left_span=("a", "b"))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BuildLeft") >= 2 and "BuildRight" not in plan and "SortMergeJoin" not in plan
    assert marked.count() == 5


def test_gene_names_that_repeat_in_a_region(spark):
    spans = spark.createDataFrame([("chr1", "p1", 0, 1000)], "chrom string, band string, start_pos long, end_pos long")
    genes = spark.createDataFrame([("chr1", 10, 20, "A"), ("chr1", 500, 600, "A"), ("chr1", 30, 40, "B")], "chrom string, start_pos long, end_pos long, gene string")
    assert iv.genes_in_region(spans, genes, ["chrom", "band"]).first()["genes"] == ["A", "B"]
    assert iv.genes_in_region(spans, genes, ["chrom", "band"], distinct=False).first()["genes"] == ["A", "A", "B"]
