import math
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandline.operators import fusion as fu
from strandline.operators.graph import connected_components, contractions
from strandline.operators.qc import qs_filter

CAND = "sample_id string, read_id string, chrom string, ref_start long, ref_end long, gene string, gene_start long, gene_end long, mapq int, mapping_span long, strand string"


def cand(spark, data):
    return spark.createDataFrame([("s", r, c, s, e, g, 0, 1, 60, e - s, "+") for r, c, s, e, g in data], CAND)


def test_similar_at_both_ends_up_to_fifty(spark):
    data = [("a", "chr1", 100, 500, "X"), ("a", "chr1", 150, 550, "Y"), ("b", "chr1", 100, 500, "X"), ("b", "chr1", 151, 500, "Y"), ("c", "chr1", 100, 500, "X"), ("c", "chr2", 100, 500, "Y")]
    assert rows(fu.overlap_artifacts(cand(spark, data)), "read_id") == [("a",)]


def test_artifacts_against_all_pairs(spark):
    rnd = random.Random(1)
    data = list({(f"r{rnd.randrange(25)}", "chr1", s := rnd.randrange(0, 700), s + rnd.randrange(200, 800), f"G{rnd.randrange(3)}") for _ in range(90)})
    want = sorted({(a[0],) for i, a in enumerate(data) for b in data[i + 1:] if a[0] == b[0] and abs(a[2] - b[2]) <= 50 and abs(a[3] - b[3]) <= 50})
    assert rows(fu.overlap_artifacts(cand(spark, data)), "read_id") == want


def test_tags_need_three_reads(spark):
    data = [(f"r{i}", "chr1", 10, 500, "A") for i in range(3)] + [(f"r{i}", "chr2", 10, 500, "B") for i in range(3)]
    data += [(f"q{i}", "chr1", 10, 500, "A") for i in range(2)] + [(f"q{i}", "chr2", 10, 500, "C") for i in range(2)]
    assert rows(fu.gene_tags(cand(spark, data)), "tag", "reads") == [("A,B", 3)]


def greedy(positions, d):
    """The order-bound rule, written out: compare with the first member only."""
    def near(a, b):
        return not (a[1] < b[0] or b[1] < a[0]) or min(abs(a[0] - b[0]), abs(a[1] - b[1]), abs(a[0] - b[1]), abs(a[1] - b[0])) <= d

    positions, used, out = sorted(positions), set(), []
    for i, p in enumerate(positions):
        if i in used:
            continue
        members = [p]
        used.add(i)
        for j, q in enumerate(positions):
            if j not in used and near(p, q):
                members.append(q)
                used.add(j)
        out.append(members)
    return out, near


@pytest.mark.parametrize("d", [100, 3])
def test_seed_clusters_against_the_written_out_rule(spark, d):
    rnd = random.Random(d)
    reads = []
    for i in range(60):
        s1, s2 = rnd.randrange(0, 1500), rnd.randrange(0, 1500)
        reads.append((s1, s1 + rnd.randrange(1, 200), s2, s2 + rnd.randrange(1, 200)))
    c1, near = greedy([r[:2] for r in reads], d)
    c2, _ = greedy([r[2:] for r in reads], d)
    want = []
    for i, a in enumerate(c1):
        for j, b in enumerate(c2):
            n = sum(any(near(r[:2], m) for m in a) and any(near(r[2:], m) for m in b) for r in reads)
            if n >= 4:
                want.append((i, j, min(m[0] for m in a), max(m[1] for m in a), n))
    pairs = spark.createDataFrame([("s", f"r{i}", "A", "B", "chr1", "chr2", *r, 60, 300) for i, r in enumerate(reads)],
                                  "sample_id string, read_id string, gene1 string, gene2 string, chr1 string, chr2 string, start1 long, end1 long, start2 long, end2 long, min_mapq int, min_span long")
    got = fu.validated_fusions(pairs, distance=d)
    assert rows(got, "cluster1", "cluster2", "c_start1", "c_end1", "reads") == sorted(want)


@pytest.mark.parametrize("sent", [0, 100_000])
def test_rows_meet_clusters_in_one_bucket_each(spark, monkeypatch, sent):
    """Long, reversed, repeated and null spans; clusters broadcast if few, and merged otherwise."""
    monkeypatch.setattr(fu, "SENT_ROWS", sent)
    rnd, d = random.Random(8), 10_000
    key = [("s", "A", "B", "chr1", "chr2"), ("s", "A", "C", "chr1", None), ("t", "A", "B", "chr1", "chr2")]
    data = []
    for _ in range(400):
        spots = [(s, s + rnd.choice([500, 2000, 60_000, -300, -25_000])) for s in (rnd.randrange(400_000), rnd.randrange(400_000))]
        data.append((*rnd.choice(key), *spots[0], *(spots[1] if rnd.random() < 0.95 else (None, 5)), 50, 300))
    data += data[:50]
    pairs = spark.createDataFrame(data, "sample_id string, gene1 string, gene2 string, chr1 string, chr2 string, start1 long, end1 long, start2 long, end2 long, min_mapq int, min_span long").repartition(3)
    found = fu.coordinate_clusters(pairs, d)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (sent == 0)
    clusters = [{r[:5] + (r.cluster,): (r.c_start, r.c_end) for r in fu._seed_clusters(pairs.select(*fu.PAIR, F.col(f"start{n}").alias("start"), F.col(f"end{n}").alias("end")), fu.PAIR, d).collect()} for n in (1, 2)]
    want = Counter()
    for *k, s1, e1, s2, e2, _, _ in data:
        if None not in (*k, s1, s2):
            met = [[(c, *span) for (*g, c), span in clusters[n].items() if g == k and span[0] is not None and min(e + d, span[1]) >= max(s - d, span[0])] for n, (s, e) in enumerate(((s1, e1), (s2, e2)))]
            want.update((*k, a[0], b[0], *a[1:], *b[1:]) for a in met[0] for b in met[1])
    want = sorted((*k, n) for k, n in want.items() if n >= fu.VALIDATED_SUPPORT)
    assert want and rows(found, *fu.PAIR, "cluster1", "cluster2", "c_start1", "c_end1", "c_start2", "c_end2", "reads") == want


def test_seed_clusters_of_one_crowded_gene_pair(spark):
    """All rows in one key: every start is within reach of its predecessor, over several Arrow batches."""
    rnd, d = random.Random(5), 20
    spots = [(s, s + rnd.randrange(1, 30)) for s in range(0, 75_000, 3) for _ in range(1 + s % 2)]
    want, reach = [], None
    for start, end in sorted(spots):
        if reach is None or start > reach:
            want.append([len(want), start, end])
            reach = end + d
        want[-1][2] = max(want[-1][2], end)
    df = spark.createDataFrame([("k", *s) for s in spots], "k string, start long, end long")
    got = rows(fu._seed_clusters(df, ["k"], d), "cluster", "c_start", "c_end")
    assert got == [tuple(w) for w in want] and len(want) > 1000
    assert fu._seed_clusters(df.limit(0), ["k"], d).count() == 0


def brute_dbscan(points, eps, need):
    near = {p: [q for q in points if abs(p[0] - q[0]) + abs(p[1] - q[1]) <= eps] for p in points}
    core = {p for p in points if sum(points[q] for q in near[p]) >= need}
    label, seen = {}, set()
    for p in sorted(core):
        if p in seen:
            continue
        todo, group = [p], set()
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            group.add(x)
            todo += [q for q in near[x] if q in core]
        for x in group:
            label[x] = min(group)
    for p in points:
        if p not in core:
            around = [label[q] for q in near[p] if q in core]
            if around:
                label[p] = min(around)
    return label


@pytest.mark.parametrize("seed,span,n", [(1, 60, 70), (2, 30, 120), (3, 200, 80)])
def test_density_clusters_against_brute_force(spark, seed, span, n):
    rnd = random.Random(seed)
    points = {}
    for _ in range(n):
        p = (rnd.randrange(span), rnd.randrange(span))
        points[p] = points.get(p, 0) + 1
    df = spark.createDataFrame([("k", *p, w) for p, w in points.items()], "k string, x long, y long, w long")
    got = {(r["x"], r["y"]): (r["label"]["x"], r["label"]["y"]) for r in fu.dbscan_labels(df, ["k"], 6, 3).collect()}
    assert got == brute_dbscan(points, 6, 3)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(rows(connected_components(df, "a", "b"), "vertex", "component"))
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200


def test_region_clusters_against_the_written_out_rule(spark):
    rnd = random.Random(9)
    spots = sorted({(s := rnd.randrange(0, 9000), s + rnd.randrange(1, 500)) for _ in range(50)})
    want, used = [], set()
    for i, (s, e) in enumerate(spots):
        if i in used:
            continue
        used.add(i)
        lo, hi, n = s, e, 1
        for j, (s2, e2) in enumerate(spots):
            if j in used:
                continue
            if not (hi < s2 or lo > e2) or (abs(lo - s2) <= 200 and abs(hi - e2) <= 200) or abs((lo + hi) // 2 - (s2 + e2) // 2) <= 200:
                used.add(j)
                lo, hi, n = min(lo, s2), max(hi, e2), n + 1
        want.append((lo, hi, n))
    df = spark.createDataFrame([("s", f"r{i}", "chr1", a, b, 60, b - a) for i, (a, b) in enumerate(spots)], "sample_id string, read_id string, chrom string, start_pos long, end_pos long, mapq int, mapping_span long")
    assert rows(fu.cluster_regions(df), "start_pos", "end_pos", "reads") == sorted(want)


def greedy_regions(regions, distance=200):
    """Cluster by cluster: the first region left opens one and passes over all later ones."""
    regions, owner, by = sorted(set(regions)), {}, {"overlap": 0, "ends": 0, "middle": 0, "left": 0}
    for i, opener in enumerate(regions):
        if opener in owner:
            continue
        owner[opener], (lo, hi) = opener, opener
        for region in regions[i + 1 :]:
            start, end = region
            if start > hi + distance:
                break
            if region in owner:
                continue
            ends = abs(lo - start) <= distance and abs(hi - end) <= distance
            middle = abs((lo + hi) // 2 - (start + end) // 2) <= distance
            if start <= hi or ends or middle:
                by["overlap" if start <= hi else "middle" if middle and not ends else "ends"] += 1
                owner[region], hi = opener, max(hi, end)
            else:
                by["left"] += 1
    return {r: f"{o[0]}-{o[1]}" for r, o in owner.items()}, by


def test_regions_join_by_each_of_three_rules(spark):
    rng = random.Random(6)
    total = dict.fromkeys(("overlap", "ends", "middle", "left"), 0)
    made, want = [], set()
    for k in range(60):
        regions = []
        for _ in range(rng.randint(1, 25)):
            start = rng.randint(0, 4000)
            regions.append((start, start + rng.choice([10, 60, 150, 380, 700, 1500])))
        owner, by = greedy_regions(regions)
        total = {r: n + by[r] for r, n in total.items()}
        made += [("s", f"chr{k}", f"r{i}", *r, 60, 500) for i, r in enumerate(regions)]
        spans = {}
        for (start, end), name in owner.items():
            lo, hi = spans.get(name, (start, end))
            spans[name] = min(lo, start), max(hi, end)
        want |= {(f"chr{k}", name, *span) for name, span in spans.items()}
    assert min(total.values()) > 0
    df = spark.createDataFrame(made, "sample_id string, chrom string, read_id string, start_pos long, end_pos long, mapq int, mapping_span long")
    assert {(r.chrom, r.cluster, r.start_pos, r.end_pos) for r in fu.cluster_regions(df).collect()} == want


def test_near_ends_mean_near_midpoints():
    """The rule on both ends never decides alone: it holds only where the midpoints are near as well."""
    rng = random.Random(8)
    for _ in range(2000):
        lo, start = rng.randint(0, 50), rng.randint(0, 50)
        hi, end = lo + rng.randint(0, 60), start + rng.randint(0, 60)
        if abs(lo - start) <= 20 and abs(hi - end) <= 20:
            assert abs((lo + hi) // 2 - (start + end) // 2) <= 20
    regions = fu.OpenRegions(200)
    assert [regions.joined(*r) for r in ((0, 10), (150, 600), (160, 210), (205, 700))] == ["0-10", "150-600", "0-10", "0-10"]


def test_contraction_shrinks_chains_stars_and_repeated_edges(spark):
    n = 3000
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = contractions(chain)
    assert len(found) <= 2 * math.log2(n)
    sizes = [t.count() for t in found]
    assert sizes[0] == n and all(b < 0.7 * a for a, b in zip(sizes, sizes[1:], strict=False) if a > 50)
    got = connected_components(chain.union(chain), "a", "b").groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [(0, n)]
    star = spark.range(1, 2000).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    assert len(contractions(star)) <= 2 * math.log2(2000)
    assert [tuple(r) for r in connected_components(star, "a", "b").groupBy("component").count().collect()] == [(1, 2000)]
    assert connected_components(star.limit(0), "a", "b").collect() == []


def test_components_by_key_against_a_search(spark):
    rng = random.Random(11)
    edges = [(rng.choice("pq"), rng.randint(0, 60), rng.randint(0, 60)) for _ in range(55)]
    want = {}
    for key in "pq":
        label = {v: v for k, *e in edges if k == key for v in e}
        for _ in label:
            for k, a, b in edges:
                if k == key:
                    label[a] = label[b] = min(label[a], label[b])
        want |= {(key, v): c for v, c in label.items()}
    got = connected_components(spark.createDataFrame(edges, "k string, a long, b long"), "a", "b", ["k"])
    assert {(r.k, r.vertex): r.component for r in got.collect()} == want


def test_more_alignments_get_more_tasks_not_larger_ones(spark, monkeypatch):
    """Candidates are dealt by read to a number of tasks that follows the alignments; what follows per read keeps it."""
    from strandline.plans import fusion_queries as fq
    from strandline.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.01")
    wanted = sorted(fu.gene_alignment_pick(fu.fusion_candidates(fu.fusion_gate(qs_filter(v.alignments)), v.regions)).collect())
    monkeypatch.setattr(fu, "TASK_ROWS", 3000)
    assert fu.tasks_for(v.alignments) == -(-v.alignments.count() // 3000) > 8
    rows = fq.candidates(v)
    found = fu.gene_alignment_pick(rows)
    assert rows.rdd.getNumPartitions() == found.rdd.getNumPartitions() == fu.tasks_for(v.alignments)
    assert sorted(found.collect()) == wanted and wanted


def test_neighbouring_cells_are_listed_within_tiles(spark, monkeypatch):
    """Points are dealt by tile, not once per neighbouring cell, and tiles of any size give the same clusters, also at their borders."""
    rnd = random.Random(9)
    points = {(rnd.randrange(-150, 150), rnd.randrange(-150, 150)): 1 for _ in range(250)}
    df = spark.createDataFrame([("k", x, y, w) for (x, y), w in points.items()], "k string, x long, y long, w long")
    want = sorted((x, y, label) for (x, y), label in brute_dbscan(points, 12, 3).items())
    for side in (1, 2, 8):
        monkeypatch.setattr(fu, "CELLS_OF_TILE", side, raising=True)
        assert sorted((r.x, r.y, tuple(r.label)) for r in fu.dbscan_labels(df, ["k"], 12, 3).collect()) == want


REGION = "sample_id string, read_id string, chrom string, start_pos long, end_pos long, mapq int, mapping_span long"


def test_rows_of_region_clusters_are_worked_out_once(spark):
    """What the regions come from may be a long plan: it runs once, however often their rows are needed."""
    seen = spark.sparkContext.accumulator(0)

    def counted(pdfs):
        for pdf in pdfs:
            seen.add(len(pdf))
            yield pdf

    data = [("s", f"r{i % 5}", "chr1", i * 70, i * 70 + 40, 60, 40) for i in range(30)]
    df = spark.createDataFrame(data, REGION).mapInPandas(counted, REGION)
    assert sum(r.reads for r in fu.cluster_regions(df).collect()) > 0
    assert seen.value == len(data)


def test_stretches_go_on_across_tiles(spark):
    rnd = random.Random(12)
    spots = sorted({("s", f"chr{rnd.randrange(3)}", a := rnd.randrange(0, 4000), a + rnd.choice([1, 5, 20, 400])) for _ in range(120)})
    want, here, reach = set(), None, None
    for sample, chrom, start, end in spots:
        if here is None or chrom != here[0] or start > reach + 10:
            here, reach = (chrom, start), end
        reach = max(reach, end)
        want.add((chrom, start, end, here[1]))
    assert 3 < len({(c, s) for c, _, _, s in want}) < len(spots)
    df = spark.createDataFrame(spots, "sample_id string, chrom string, start_pos long, end_pos long")
    for tile in (7, 100, 1 << 20):
        got = fu.stretches_of(df, ["sample_id", "chrom"], 10, tile).collect()
        assert len(got) == len(spots) and {(r.chrom, r.start_pos, r.end_pos, r.stretch) for r in got} == want
