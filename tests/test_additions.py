"""Nested bins, apportioned samples, fitted widths, batch plans, JSON logs and ordered files against written-out rules."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandline.functions.tags import aligned_blocks
from strandline.operators import cnv, qc
from strandline.operators.intervals import BUCKET, LEVELS, interval_join, nested_interval_join
from strandline.operators.ranges import source_report
from strandline.session import scratch_path
from strandline.sinks import layouts as lay
from strandline.sources.text import log_proportions, log_shapes, read_json_log
from strandline.streaming import pipelines as st

LEFT = "chrom string, a long, b long, left_id int"
RIGHT = "chrom string, start_pos long, end_pos long, right_id int"


def spans(rng, n):
    edges = [0, BUCKET, 8 * BUCKET, 64 * BUCKET, 8**5 * BUCKET]
    for i in range(n):
        start = max(0, rng.choice(edges) + rng.randint(-40, 40)) if rng.random() < 0.5 else rng.randint(0, 10**7)
        yield rng.choice(["c1", "c2"]), start, start + rng.choice([0, 1, 30, BUCKET, 9 * BUCKET, 10**6, 2 * 10**8]), i


@pytest.mark.parametrize(("closed", "least"), [(False, 0), (True, 0), (False, 20)])
def test_nested_bins_give_the_pairs_of_all_pairs(spark, closed, least):
    rng = random.Random(least + closed)
    left, right = list(spans(rng, 120)), list(spans(rng, 120))
    more = 1 if closed else 0
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < x[2] + more and y[1] < y[2] + more and min(x[2], y[2]) + more - max(x[1], y[1]) > least)
    pairs = nested_interval_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), left_span=("a", "b"), min_overlap=least, closed=closed)
    assert rows(pairs, "left_id", "right_id") == want
    assert "_own" not in pairs.columns and pairs.columns == [*"chrom a b left_id start_pos end_pos right_id".split()]


def test_a_chromosome_is_stored_once(spark):
    whole = spark.createDataFrame([("c1", 0, 248_000_000, 0)], LEFT)
    right = spark.createDataFrame([("c1", i * 500_000, i * 500_000 + 10, i) for i in range(400)], RIGHT)
    nested = nested_interval_join(whole, right, left_span=("a", "b"))
    assert rows(nested, "right_id") == rows(interval_join(whole, right, left_span=("a", "b")), "right_id") == [(i,) for i in range(400)]
    from strandline.operators.intervals import _own_bin, _wider_bins

    own = whole.withColumn("own", _own_bin(F.col("a"), F.col("b") - 1))
    assert own.select(1 + F.size(_wider_bins(F.col("own")))).first()[0] <= LEVELS + 1 and own.select("own.level").first()[0] >= 5


def shares_written_out(sizes, budget):
    total, series = sum(sizes.values()), sorted(sizes)
    if total <= budget:
        return sizes
    if len(series) > budget:
        kept = sorted(series, key=lambda s: (-sizes[s], s))[:budget]
        return {s: int(s in kept) for s in series}
    spare, room = budget - len(series), total - len(series)
    down = {s: spare * (sizes[s] - 1) // room for s in series}
    turn = sorted(series, key=lambda s: (-(spare * (sizes[s] - 1) % room), s))
    extra = set(turn[: spare - sum(down.values())])
    return {s: 1 + down[s] + (s in extra) for s in series}


def test_budget_is_met_exactly_and_spread_evenly(spark):
    rng = random.Random(2)
    groups = {f"g{i}": {f"c{k}": rng.choice([1, 2, 7, 40, 300]) for k in range(rng.randint(1, 9))} for i in range(25)}
    sizes = spark.createDataFrame([(g, c, n) for g, s in groups.items() for c, n in s.items()], "sample_id string, chrom string, n long")
    for budget in (3, 20, 77):
        got = {(r.sample_id, r.chrom): r.share for r in cnv.apportioned(sizes, budget, ["sample_id"], ["chrom"]).collect()}
        for g, s in groups.items():
            mine = {c: got[g, c] for c in s}
            assert mine == shares_written_out(s, budget) and sum(mine.values()) == min(budget, sum(s.values())) and all(mine[c] <= s[c] for c in s)
    track = sizes.withColumn("bin_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("value", F.lit(1.0)).drop("n")
    taken = cnv.even_sample_budget(track, 20)
    for r in taken.groupBy("sample_id").count().collect():
        assert r["count"] == min(20, sum(groups[r.sample_id].values()))
    ends = taken.groupBy("sample_id", "chrom").agg(F.min("bin_idx").alias("a"), F.max("bin_idx").alias("z"), F.count("*").alias("n")).collect()
    assert all((r.a, r.z) == (0, groups[r.sample_id][r.chrom] - 1) for r in ends if r.n > 1)


def test_width_follows_depth_whatever_the_parts(spark):
    rng = random.Random(5)
    starts = [(s, f"chr{rng.randint(1, 3)}", rng.randint(0, 16_000_000), 60) for s, n in (("deep", 9000), ("thin", 900)) for _ in range(n)]
    df = spark.createDataFrame(starts, "sample_id string, chrom string, ref_start long, mapq int")
    parts = [cnv.base_counts(df.filter(f"ref_start % 3 = {i}")) for i in range(3)]
    bins = cnv.fitted_bins(parts[0].union(parts[1]).union(parts[2]))
    assert rows(bins, *bins.columns) == rows(cnv.fitted_bins(cnv.base_counts(df)), *bins.columns)
    got = {r.sample_id: r for r in cnv.width_and_variance(bins).collect()}
    for sample in ("deep", "thin"):
        mine = [(c, p) for s, c, p, _ in starts if s == sample]
        for k in range(7):
            width = 125_000 << k
            last = {c: max(p for d, p in mine if d == c) // width for c, _ in mine}
            if len(mine) >= 30 * sum(v + 1 for v in last.values()) or k == 6:
                break
        counts = {c: [0] * (v + 1) for c, v in last.items()}
        for c, p in mine:
            counts[c][p // width] += 1
        level = 2 * sum(map(len, counts.values())) / len(mine)
        steps = [(level * (b - a)) ** 2 for v in counts.values() for a, b in zip(v, v[1:], strict=False)]
        r = got[sample]
        assert (r.width, r.bins, r.reads) == (width, sum(map(len, counts.values())), len(mine)) and r.variance == pytest.approx(sum(steps) / 2 / len(steps))
    assert got["deep"].width < got["thin"].width


def plan_written_out(log, large):
    limits, out, state = {"cnv": 50, "preprocessing": 1}, {}, {}
    for sample, job, file, ts, size in sorted(log, key=lambda r: (r[3], r[2])):
        s = state.setdefault((sample, job), {"ts": None, "session": 0, "rest": 0, "large": 0})
        if s["ts"] is None or ts - s["ts"] >= 2000:
            s.update(session=s["session"] + 1, rest=0, large=0)
        s["ts"] = ts
        if size > large:
            s["large"] += 1
            out[sample, job, file] = s["session"], -s["large"]
        else:
            out[sample, job, file] = s["session"], s["rest"] // limits.get(job, 20)
            s["rest"] += 1
    return out


def test_batch_plan_against_a_walk_over_the_log(spark):
    rng = random.Random(9)
    log, ts = [], 0
    for i in range(700):
        ts += rng.choice([0, 1, 20, 90, 1999, 2000, 2600]) if rng.random() < 0.2 else rng.randint(0, 15)
        log.append((rng.choice("ab"), rng.choice(["cnv", "mgmt", "preprocessing"]), f"f{i:04}", ts, rng.choice([1.0, 2.0, 300.0, 301.0])))
    df = spark.createDataFrame(log, "sample_id string, job_type string, file string, ts_ms long, size double")
    got = {(r.sample_id, r.job_type, r.file): (r.session, r.batch) for r in qc.batch_plan(df, 300.0).collect()}
    assert got == plan_written_out(log, 300.0) and {b for _, b in got.values()} >= {-2, -1, 0, 1, 2}


def test_json_log_keeps_every_line_in_a_count(spark):
    lines = [
        '{"sample_id": "s", "ts": 1, "proportions": {"a": 0.5, "b": 1}}', '{"sample_id": "s", "ts": 2, "type": "a", "proportion": 0.25, "more": [1]}',
        '{"sample_id": "s", "ts": 3', "no json", '{"sample_id": "s", "ts": 4}', "  ", '{"sample_id": "s", "ts": 5, "proportions": {}}',
    ]
    path = scratch_path(spark, "log")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    log = read_json_log(spark, path)
    assert rows(log_shapes(log), "shape", "lines") == [("broken", 2), ("map", 2), ("other", 1), ("single", 1)]
    found = log_proportions(log).select("ts", F.explode("proportions").alias("type", "p"))
    assert rows(found, "ts", "type", "p") == [(1, "a", 0.5), (1, "b", 1.0), (2, "a", 0.25)]


def test_ordered_parts_and_ranges_that_open_few_of_them(spark):
    data = [(f"chr{c}\t{p}\tx{p % 3}",) for c in (1, 10, 2) for p in range(0, 2000, 7)] * 2
    path = scratch_path(spark, "ordered")
    fields = F.split("value", "\t")
    lay.write_ordered(spark.createDataFrame(data, "value string"), [fields[0], fields[1].cast("long")], path, rows_per_part=100)
    want = sorted((v.split("\t")[0], int(v.split("\t")[1]), v) for (v,) in data)
    got = sorted(tuple(r) for r in lay.read_ordered(spark, path).collect())
    assert got == [(i + 1, v) for i, (*_, v) in enumerate(want)]
    manifest = spark.read.parquet(f"{path}/manifest")
    assert manifest.count() > 10 and manifest.agg(F.sum("rows")).first()[0] == len(data)
    some = lay.read_ordered(spark, path, ("chr10", 500), ("chr10", 600)).collect()
    inside = [(i + 1, v) for i, (c, p, v) in enumerate(want) if c == "chr10" and 500 <= p <= 600]
    assert set(inside) <= {tuple(r) for r in some} and len(some) < 450
    assert lay.read_ordered(spark, path, ("chr3",)).collect() == []


def test_many_small_parts_come_from_few_tasks(spark, monkeypatch):
    """One task writes its parts one after the other; their order is that of the numbers in their names, beyond three digits too."""
    monkeypatch.setattr(lay, "TASK_PARTS", 2000, raising=False)
    data = [(f"chr1\t{p}",) for p in range(1200)]
    path = scratch_path(spark, "parts")
    fields = F.split("value", "\t")
    lay.write_ordered(spark.createDataFrame(data[::-1], "value string"), [fields[0], fields[1].cast("long")], path, rows_per_part=1)
    files = [r.file for r in spark.read.parquet(f"{path}/manifest").collect()]
    assert len(files) == 1200 and len({f.split("-")[1] for f in files}) == 1
    assert sorted(tuple(r) for r in lay.read_ordered(spark, path).collect()) == [(i + 1, v) for i, (v,) in enumerate(data)]


def test_a_changed_file_counts_again_and_a_repeated_one_does_not(spark):
    path = scratch_path(spark, "listing")
    for n, part in enumerate([[("s", "f1", 10, 1), ("s", "f2", 20, 1)], [("s", "f1", 10, 1)], [("s", "f1", 11, 2), ("s", "f2", 20, 1)], [("s", "f1", 11, 2)]]):
        spark.createDataFrame(part, "sample_id string, path string, size long, modified int").coalesce(1).write.parquet(f"{path}/n{n}")
    listing = st.stream_alignments(spark, path, spark.read.parquet(f"{path}/n0").schema, 1)
    out, ck = scratch_path(spark, "o"), scratch_path(spark, "c")
    for _ in range(2):
        assert rows(st.changed_files(listing, out, ck), "path", "size", "modified") == [("f1", 10, 1), ("f1", 11, 2), ("f2", 20, 1)]


def test_source_report_counts_and_covers(spark):
    one = "chrom string, start_pos long, end_pos long, name string, strand string"
    cnv_in = spark.createDataFrame([("c1", 50_000, 60_000, "a")], "chrom string, start_pos long, end_pos long, name string")
    fusion = spark.createDataFrame([("c1", 100, 200, "b", "+"), ("c1", 150, 300, "c", "+"), ("c2", 0, 500, "d", ".")], one)
    panel = spark.createDataFrame([("c1", 250, 400, "p", "+"), ("c2", 400, 900, "q", "-")], one)
    lengths = spark.createDataFrame([("c1", 100_000), ("c2", 1000)], "chrom string, length long")
    got = {r.source: (r.regions, round(r.plus_proportion * 101_000), round(r.minus_proportion * 101_000)) for r in source_report({"cnv": cnv_in, "fusion": fusion}, panel, lengths).collect()}
    assert got == {"cnv": (4, 30_000, 30_000), "fusion": (4, 700, 500), "target_panel": (2, 150, 500), "master": (5, 30_800, 30_900)}


def test_timeline_adds_up_and_files_count_once(spark):
    part = "sample_id string, chrom string, start_pos long, end_pos long, name string, length long, coverage double, bases long, ts date, batch_id int"
    parts = spark.createDataFrame([("s", "c1", 1, 100, "t", 100, 0.0, b, None, n) for n, b in ((0, 50), (2, 25), (5, 25))], part)
    assert rows(st.coverage_timeline(parts), "batch_id", "bases", "total", "coverage") == [(0, 50, 50, 0.5), (2, 25, 75, 0.75), (5, 25, 100, 1.0)]
    calls = spark.range(60).select(F.lit("s").alias("sample_id"), F.concat(F.lit("f"), F.col("id") % 7).alias("file"), F.lit("c").alias("chrom"), F.col("id").alias("pos"), *[F.lit(1).alias(c) for c in ("valid_cov", "n_mod", "n_canonical")])
    path, out = scratch_path(spark, "calls"), scratch_path(spark, "o")
    calls.repartition(5).write.parquet(path)
    st.stream_methylation(st.stream_alignments(spark, path, calls.schema, 1), out, scratch_path(spark, "c"))
    assert rows(st.files_per_sample(spark, out), "sample_id", "files") == [("s", 7)]


def test_blocks_of_every_operation(spark):
    shapes = {"3H5S4M2I6M1D2M7S": [(100, 104, 5), (104, 110, 11), (111, 113, 17)], "2=1X300N5M": [(100, 102, 0), (102, 103, 2), (403, 408, 3)], "4M2P3M": [(100, 104, 0), (104, 107, 4)], "*": [], "9I": [], "5N2M": [(105, 107, 0)]}
    df = spark.createDataFrame([(c, 100) for c in shapes], "cigar string, ref_start long")
    got = aligned_blocks(df)
    for cigar, want in shapes.items():
        assert rows(got.filter(F.col("cigar") == cigar), "block_start", "block_end", "read_offset") == want
