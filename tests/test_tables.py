import itertools
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandline.functions.quantiles import exact_quantiles
from strandline.functions.tags import info_map, supplementary_spans
from strandline.operators import cnv
from strandline.operators import coverage as cv
from strandline.operators import methylation as me
from strandline.operators import qc
from strandline.operators import variants as va
from strandline.sources import text as src


def test_quantiles_equal_numpy(spark):
    rnd = random.Random(2)
    groups = {"a": [rnd.random() for _ in range(301)], "b": [1.0, 2.0], "c": [5.0], "d": [float(rnd.randrange(4)) for _ in range(200)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for r in exact_quantiles(df, ["k"], "v", probs, [f"q{i}" for i in range(5)]).collect():
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(groups[r["k"]], probs)))


def test_coverage_sweep_over_tiles(spark):
    rnd = random.Random(4)
    reads = [(s := rnd.randrange(0, 900), s + rnd.randrange(1, 120)) for _ in range(60)]
    df = spark.createDataFrame([("s", "chr1", a, b, False, False) for a, b in reads], "sample_id string, chrom string, ref_start long, ref_end long, is_unmapped boolean, is_secondary boolean")
    depth = np.zeros(2000)
    for a, b in reads:
        depth[a:b] += 1
    lengths = spark.createDataFrame([("chr1", 2000)], "chrom string, length long")
    for tile in (100, 1 << 20):
        assert rows(cv.genome_coverage(df, lengths, tile), "numreads", "covbases", "meandepth") == [(60, int((depth > 0).sum()), depth.sum() / 2000)]


CALL = "sample_id string, read_id string, chrom string, pos long, strand string, mod_code string, prob int"


def test_combined_calls_at_the_threshold(spark):
    data = [("a", 1, "m", 186), ("b", 2, "m", 185), ("c", 3, "m", 0), ("d", 4, "m", 70), ("e", 5, "m", 200), ("e", 5, "h", 220), ("f", 6, "m", 255)]
    df = spark.createDataFrame([("s", r, "chr1", p, "+", c, q) for r, p, c, q in data], CALL)
    got = rows(me.mod_site_counts_combined(df), "pos", "n_mod", "n_canonical", "n_fail")
    # 70 leaves 185 for the canonical base, which is one below the limit
    assert got == [(1, 1, 0, 0), (2, 0, 0, 1), (3, 0, 1, 0), (4, 0, 0, 1), (5, 1, 0, 0), (6, 1, 0, 0)]


def test_other_code_above_the_threshold(spark):
    data = [("a", 1, "m", 0), ("a", 1, "h", 200), ("b", 1, "m", 100), ("b", 1, "h", 100)]
    df = spark.createDataFrame([("s", r, "chr1", p, "+", c, q) for r, p, c, q in data], CALL)
    assert rows(me.mod_site_counts_by_code(df), "mod_code", "n_mod", "n_other_mod", "n_fail") == [("h", 1, 0, 1), ("m", 0, 1, 1)]


def test_probe_margins_and_signs(spark):
    probes = spark.createDataFrame([("chr1", 100, "p")], "chrom string, start_pos long, probe_name string")
    calls = spark.createDataFrame([("s", "chr1", p, 0.9) for p in (73, 74, 75, 126, 127)], "sample_id string, chrom string, pos long, score double")
    assert rows(me.probe_margin_join(calls, probes), "pos") == [(75,), (126,)]
    tie = spark.createDataFrame([("s", "chr1", 100, 0.9), ("s", "chr1", 101, 0.1), ("s", "chr1", 102, 0.7)], "sample_id string, chrom string, pos long, score double")
    assert me.probe_calls(tie, probes).count() == 0


def test_reads_fail_by_their_primary_only(spark):
    data = [("a", False, 11.0), ("a", True, 30.0), ("b", False, None), ("b", True, 3.0), ("c", False, 12.0)]
    df = spark.createDataFrame([("s", r, False, s, q) for r, s, q in data], "sample_id string, read_id string, is_secondary boolean, is_supplementary boolean, qs double")
    assert rows(qc.qs_filter(df), "read_id") == [("b",), ("b",), ("c",)]


def test_sample_ids(spark):
    rg = spark.createDataFrame([("f1", "LIB", "run1"), ("f2", None, "run1"), ("f3", None, None), ("f4", "L_barcode07", None)], "file string, library string, runid string")
    reads = spark.createDataFrame([("f1", "r1", "x_barcode7"), ("f2", "r1", "x_barcode97"), ("f4", "r1", "x_barcode07")], "file string, read_id string, rg string")
    assert rows(qc.barcode_sample_id(reads, rg), "file", "sample_id") == [("f1", "LIB_barcode07"), ("f2", "run1"), ("f3", "unknown_sample_f3"), ("f4", "L_barcode07")]


def test_size_gate(spark):
    df = spark.createDataFrame([("s", "a", 50001, 0), ("s", "b", 0, 5), ("s", "c", 1, 200), ("s", "d", 0, 0)], "sample_id string, file string, mapped_reads long, unmapped_reads long")
    assert rows(qc.file_size_gate(df), "file", "status", "warning") == [("a", "ok", "large"), ("b", "ok", "no_alignments"), ("c", "ok", "few_alignments"), ("d", "ok", "empty")]


def test_sa_entries(spark):
    df = spark.createDataFrame([("r1", "chr1,100,+,50M10S,60,1;chrM,1,+,5M,60,0;chr2,7,-,*,x,0;"), ("r2", None)], "read_id string, sa string")
    assert rows(supplementary_spans(df), "sa_chrom", "sa_start", "sa_end", "sa_mapq") == [("chr1", 100, 160, 60), ("chr2", 7, 107, 0)]


def test_info_text(spark):
    df = spark.createDataFrame([("A=1;FLAG;B=x=y;A=2",)], "i string").select(info_map(F.col("i")).alias("m"))
    assert df.first()["m"] == {"FLAG": "true", "B": "x=y", "A": "2"}


def test_conflicting_records_vote_by_terms(spark):
    data = [("CLNSIG=Conflicting_classifications_of_pathogenicity;CLNSIGCONF=Pathogenic(3)|Benign(1)",), ("CLNSIG=Conflicting_classifications_of_pathogenicity;CLNSIGCONF=Pathogenic(1)|Benign(1)",), ("CLNSIG=Pathogenic/Likely_pathogenic",), ("X=1",)]
    df = spark.createDataFrame(data, "info string").select(va.is_pathogenic(F.col("info"), "terms").alias("t"), va.is_pathogenic(F.col("info")).alias("s"))
    assert [(r["t"], r["s"]) for r in df.collect()] == [(True, True), (False, True), (True, True), (False, False)]


def segment_cost(x):
    return float(((x - x.mean()) ** 2).sum())


def test_segments_have_the_least_cost():
    rnd = np.random.default_rng(3)
    for penalty in (0.5, 2.0):
        for _ in range(12):
            x = np.round(rnd.normal(0, 1, 9) + np.repeat([0, 3, 0], 3), 2)
            best = np.inf
            for k in range(4):
                for cut in itertools.combinations(range(2, 8), k):
                    edges = [0, *cut, 9]
                    if min(np.diff(edges)) >= 2:
                        best = min(best, sum(segment_cost(x[a:b]) for a, b in itertools.pairwise(edges)) + penalty * k)
            ends = cnv._best_splits(x, penalty)
            edges = [0, *ends]
            assert ends[-1] == 9 and min(np.diff(edges)) >= 2
            assert sum(segment_cost(x[a:b]) for a, b in itertools.pairwise(edges)) + penalty * (len(ends) - 1) == pytest.approx(best)


def track(spark, values, chrom="chr1"):
    return spark.createDataFrame([("s", chrom, i, float(x)) for i, x in enumerate(values)], "sample_id string, chrom string, bin_idx long, value double")


def test_moving_average_repeats_the_edges(spark):
    x = [1, 5, 2, 8, 3, 9]
    for n in (3, 5):
        want = [np.mean([x[min(max(i + d, 0), 5)] for d in range(-(n // 2), n // 2 + 1)]) for i in range(6)]
        got = [r["value"] for r in cnv.moving_average(track(spark, x), n).orderBy("bin_idx").collect()]
        assert got == pytest.approx(want)


def test_runs_break_at_gaps_and_signs(spark):
    got = cnv.significant_regions(track(spark, [0.6, 0.7, 0.5, 0.9, -0.9, -0.6]), width=10)
    assert rows(got, "start_pos", "end_pos", "type") == [(0, 20, "gain"), (30, 40, "gain"), (40, 60, "loss")]


def test_even_samples(spark):
    for n, k in ((50, 12), (13, 12), (12, 12), (101, 7)):
        want = list(range(n)) if n <= k else [round(i * (n - 1) / (k - 1)) for i in range(k)]
        assert [r[0] for r in rows(cnv.even_sample(track(spark, range(n)), k), "bin_idx")] == want


def test_text_files_are_read_back(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.bed.gz", "wt") as f:
        f.write("#x\nchr1\t1\t5\nchr2\t3\t9\tG\t.\t?\n")
    assert rows(src.read_bed(spark, str(tmp_path / "a.bed.gz")), "chrom", "name", "score", "strand") == [("chr1", ".", "0", "."), ("chr2", "G", "0", ".")]
    (tmp_path / "c.txt").write_text("chr start end IlmnID\nchr1 11 12 cg1\n")
    assert rows(src.read_cpg_filter(spark, str(tmp_path / "c.txt")), "start_pos", "end_pos") == [(10, 12)]
    (tmp_path / "v.vcf").write_text("##h\n#CHROM\tPOS\nchr1\t5\t.\tA\tC\t.\tPASS\tN=a#b\tGT\t0/1\n")
    assert rows(src.read_vcf(spark, str(tmp_path / "v.vcf")), "pos", "info") == [(5, "N=a#b")]
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t2064\tchr1\t10\t60\t5S20M3D\t*\t0\t0\t*\t*\tSA:Z:chr2,5,+,5M,60,0;\tqs:f:11.5\n")
    r = src.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (r["ref_start"], r["ref_end"], r["strand"], r["is_supplementary"], r["query_length"], r["qs"], r["file"]) == (9, 32, "-", True, 25, 11.5, "a.sam")


def test_bed_errors(spark):
    lines = [(1, "chr1\t1"), (2, "1\t5\t2\tG"), (3, "chr1\t1\t5\tG\t0\t+"), (4, "chr1\t-1\t5\tG")]
    got = src.validate_bed(spark.createDataFrame(lines, "line long, value string"))
    assert rows(got, "line", "errors") == [(1, "fewer than 3 fields"), (2, "chromosome without chr; start not below end"), (4, "negative position")]


def test_rolling_median_equals_pandas(spark, monkeypatch):
    import pandas as pd

    from strandline.operators import rolling

    monkeypatch.setattr(rolling, "TILE", 16)
    rnd = random.Random(8)
    data = [("a", i, round(rnd.random() * 30, 1)) for i in range(300)] + [("b", i, float(i % 3)) for i in range(12)] + [("c", 1, 1.0)]
    pdf = pd.DataFrame(data, columns=["job_type", "job_id", "duration_seconds"])
    want = {}
    for k, g in pdf.groupby("job_type"):
        if len(g) >= 10:
            med = g["duration_seconds"].rolling(max(10, len(g) // 20), min_periods=5).median()
            want.update({(k, j): None if np.isnan(m) else m for j, m in zip(g["job_id"], med)})
    df = spark.createDataFrame(data, "job_type string, job_id long, duration_seconds double")
    got = rolling.rolling_median(df, order=["job_id"], time_number=F.col("job_id"))
    assert {(r["job_type"], r["job_id"]): r["rolling_median"] for r in got.collect()} == pytest.approx(want)


def test_feature_blocks_hold_every_probe(spark):
    probes = spark.createDataFrame([("chr1", 20 * i, f"cg{i}") for i in range(200)], "chrom string, start_pos long, probe_name string")
    data = [(s, f"cg{i}", 1 if i % 3 else -1) for s in ("a", "b") for i in range(0, 200, 2)] + [("a", "cg0", 1)]
    got = me.feature_blocks(spark.createDataFrame(data, "sample_id string, probe_id string, methylation_call long"), probes).collect()
    assert {(r.sample_id, r.chrom, r.block) for r in got} == {(s, "chr1", b) for s in ("a", "b") for b in range(4)}
    assert {(r.sample_id, p): c for r in got for p, c in r.calls.items()} == {(s, p): c for s, p, c in data}
