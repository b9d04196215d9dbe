import random
from types import SimpleNamespace

import __spark_entry__ as entry_point
from conftest import rows
from pyspark.sql import functions as F

from strandline.operators import fusion as fu
from strandline.operators.qc import qs_filter
from strandline.plans import stream_queries
from strandline.session import scratch_path
from strandline.sinks.layouts import append_candidates
from strandline.streaming import pipelines as st
from strandline.streaming import states


def feed(spark, df, files):
    path = scratch_path(spark, "t")
    df.repartition(files, "file").write.parquet(path)
    return path


def meth(spark):
    return spark.range(200).select(F.lit("s").alias("sample_id"), F.concat(F.lit("f"), F.col("id") % 8).alias("file"), F.lit("chr1").alias("chrom"), (F.col("id") % 10).alias("pos"),
                                   F.lit(10).alias("valid_cov"), F.lit(3).alias("n_mod"), F.lit(7).alias("n_canonical"))


def test_any_number_of_batches_gives_one_state(spark):
    df = meth(spark)
    path = feed(spark, df, 4)
    want = rows(df.groupBy("pos").agg(F.sum("n_mod").alias("n_mod")), "pos", "n_mod")
    for per_batch in (1, 4):
        stream = st.stream_alignments(spark, path, df.schema, per_batch)
        got = st.stream_methylation(stream, scratch_path(spark, "o"), scratch_path(spark, "c"))
        assert rows(got, "pos", "n_mod") == want


def test_a_second_run_reads_no_file_again(spark):
    df = meth(spark)
    path, out, ck = feed(spark, df, 4), scratch_path(spark, "o"), scratch_path(spark, "c")
    for _ in range(2):
        got = st.stage_and_accumulate(st.stream_alignments(spark, path, df.schema, 1), out, ck, limit=3)
        assert got.count() == 200


def test_files_once(spark):
    df = meth(spark)
    path = feed(spark, df.unionByName(df.withColumn("sample_id", F.lit("again"))), 1)
    got = st.idempotent_files(st.stream_alignments(spark, path, df.schema), scratch_path(spark, "o"), scratch_path(spark, "c"))
    assert got.count() == 8


def test_ignored_names(spark):
    df = meth(spark)
    path = feed(spark, df, 2)
    stream = st.stream_alignments(spark, path, df.schema, ignore=["part-*"])
    out = scratch_path(spark, "o")
    st.drain(stream, lambda d, n: st.put(d, out, n), scratch_path(spark, "c"))
    assert spark.read.parquet(out).count() == 0


def test_a_repeated_batch_replaces_itself(spark):
    rows_ = spark.range(5).select(F.lit("target").alias("candidate_type"), F.lit("s").alias("sample_id"), "id")
    path = scratch_path(spark, "cand")
    append_candidates(rows_, path, 0)
    append_candidates(rows_, path, 0)
    append_candidates(rows_, path, 1)
    assert spark.read.parquet(path).count() == 10


REGIONS = [("chr1", 1000, 3000, "A"), ("chr1", 10_000, 13_000, "B"), ("chr2", 1000, 3000, "C")]


def alignment(read, gene, offset=0, qs=20.0, extra=False, sa="chr2,1500,+,400M,60,0;"):
    chrom, start, _, _ = REGIONS["ABC".index(gene)]
    return ("s", f"r{read}", chrom, start + 100 + offset, start + 600 + offset, False, False, extra, 60, sa, qs, "+", 0, 500)


NAMES = "sample_id string, read_id string, chrom string, ref_start long, ref_end long, is_unmapped boolean, is_secondary boolean, is_supplementary boolean, mapq int, sa string, qs double, strand string, read_start long, read_end long"

#: Per batch the alignments that arrive with it.
ARRIVALS = [
    [alignment(i, "A") for i in range(12)] + [alignment(12, "A", qs=5.0)],
    [alignment(i, "B", extra=True) for i in range(9)] + [alignment(12, "B", extra=True)],
    # 0 and 1 move to another tag, 2 loses its own by a near copy, 9 to 11 join late
    [alignment(0, "C", extra=True), alignment(1, "C", extra=True), alignment(2, "B", 20, extra=True)] + [alignment(i, "C", extra=True) for i in (9, 10, 11)],
    # 3 fails after it had a tag, 4 gets a far alignment on a gene it has, 13 fails before its genes come
    [alignment(3, "A", 300, qs=3.0), alignment(4, "B", 900, extra=True), alignment(13, "A", qs=1.0)],
    [alignment(13, "B", extra=True), alignment(0, "B", 2000, extra=True)],
]


def arrivals(spark, batches):
    path = scratch_path(spark, "arrivals")
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, NAMES).coalesce(1).write.parquet(f"{path}/n{n}")
    return st.stream_alignments(spark, path, spark.createDataFrame([], NAMES).schema, 1)


def panel(spark):
    return spark.createDataFrame([(c, s, e, g, "target") for c, s, e, g in REGIONS], "chrom string, start_pos long, end_pos long, name string, region_type string")


def test_tags_that_change_end_and_fail_late(spark):
    rows_ = spark.createDataFrame([r for b in ARRIVALS for r in b], NAMES)
    clean = fu.without_artifacts(fu.fusion_candidates(fu.fusion_gate(qs_filter(rows_)), panel(spark)))
    want = rows(fu.supported_rows(clean).select("read_id", "tag").distinct(), "read_id", "tag")
    out = scratch_path(spark, "o")
    assert rows(st.stream_fusion_tags(arrivals(spark, ARRIVALS), panel(spark), out, scratch_path(spark, "c")), "read_id", "tag") == want
    assert {t for _, t in want} == {"A,B", "A,C"} and not {"r2", "r3", "r12", "r13"} & {r for r, _ in want}
    changes = {(r.read_id, r.version): (r.before, r.tag) for r in spark.read.parquet(f"{out}/changes").collect()}
    assert changes["r0", 2] == ("A,B", "A,B,C") and changes["r2", 2] == ("A,B", None) and changes["r3", 2] == ("A,B", None) and ("r4", 2) not in changes


def test_a_batch_reads_its_own_rows_only(spark):
    """Many batches of equally many rows on the same reads: input and touched states stay as they are."""
    batches = [[alignment(i, "ABC"[(i + n) % 3], 50 * n, extra=n > 0) for i in range(8)] for n in range(6)]
    seen = []
    stream = arrivals(spark, batches)
    found = fu.fusion_candidates(fu.fusion_gate(stream), panel(spark))
    events = st._with_state(found, stream, states.PLACE, states.tag_change, states.TAG_CHANGE, states.TAG_STATE)
    query = events.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    for p in query.recentProgress:
        seen.append((p["numInputRows"], p["stateOperators"][0]["numRowsUpdated"], p["stateOperators"][0]["numRowsTotal"]))
    assert len(seen) == 6 and {s[1:] for s in seen} == {(8, 8)} and len({s[0] for s in seen}) == 1


def test_pairs_across_batches_and_late_failure(spark):
    batches = [[alignment(i, "A", sa="chr2,1500,+,400M,60,0;") for i in range(5)], [alignment(0, "A", 5, qs=2.0), alignment(9, "A")], [alignment(1, "A", 4)]]
    out = st.stream_breakpoint_clusters(arrivals(spark, batches), panel(spark), scratch_path(spark, "o"), scratch_path(spark, "c"))
    assert [(r.p_chrom, r.s_chrom, r.batch_id, r.reads) for r in out.collect()] == [("chr1", "chr2", 0, 5)]
    support = states._pairs(["p\tchr1\t1000\t+", "s\tchr2\t1500\t+", "s\tchr1\t500\t-"])
    assert support == {(("chr1", 1000, "+"), ("chr2", 1500, "+")), (("chr1", 500, "-"), ("chr1", 1000, "+"))}


def test_near_places_against_all_pairs():
    rng = random.Random(4)
    for _ in range(300):
        spots = sorted({(rng.choice("ab"), rng.randint(0, 400), rng.randint(0, 400), rng.choice("xyz"), 0, 1) for _ in range(rng.randint(1, 7))})
        want = any(a[0] == b[0] and abs(a[1] - b[1]) <= 50 and abs(a[2] - b[2]) <= 50 for i, a in enumerate(spots) for b in spots[i + 1 :])
        assert states.near_places(["\t".join(map(str, s)) for s in spots]) == want


def test_more_rows_come_in_more_files_not_in_larger_ones(spark, monkeypatch):
    """No task writes or reads a fixed share of the table; the batches stay as they are."""
    from strandline.plans import stream_queries as sq
    from strandline.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    rows = v.alignments.count()
    wanted = {n: [tuple(r) for r in entry_point.queries()[n](spark, v.sf_dir).collect()] for n in ("STM1_micro_batches", "STM3_coverage_timeline")}
    monkeypatch.setattr(sq, "FILE_ROWS", 250)
    assert sq.file_factor(v.alignments, 4) == -(-rows // 1000)
    for key in (None, "read_id"):
        files = sq.arriving(v, v.alignments, key)
        seen = []
        st.drain(files.select("read_id", "_metadata.file_path"), lambda df, n: seen.append(max(r["count"] for r in df.groupBy("file_path").count().collect())), sq.scratch_path(spark, "ck"))  # noqa: B023
        assert len(seen) == 2 and max(seen) < 500
    for name, before in wanted.items():
        assert sorted(tuple(r) for r in entry_point.queries()[name](spark, v.sf_dir).collect()) == sorted(before)


def test_changes_of_reads_come_from_the_plan_without_python(spark, monkeypatch):
    """Tags and pairs per batch equal the rules for one read in Python, and no batch starts a Python function per read."""
    rng = random.Random(11)
    spots = [(g, off) for g in "ABC" for off in (0, 30, 400)]
    batches = [[alignment(i, *rng.choice(spots), qs=rng.choice([20.0] * 9 + [3.0]), extra=rng.random() < 0.6) for i in range(12) for _ in range(rng.randint(0, 2))] or [alignment(0, "A")] for _ in range(3)]

    def by_read(columns, change, changed, state, found):
        stream = arrivals(spark, batches)
        path = scratch_path(spark, "byread")
        st.to_files(st._with_state(found(stream), stream, columns, change, changed, state), path, scratch_path(spark, "c"))
        return sorted(map(tuple, spark.read.schema(changed).parquet(path).collect()), key=str)

    tags = by_read(states.PLACE, states.tag_change, states.TAG_CHANGE, states.TAG_STATE, lambda s: fu.fusion_candidates(fu.fusion_gate(s), panel(spark)))

    def ends(stream):
        p = fu.on_panel(fu.fusion_gate(stream), panel(spark))
        a, b = (df.select(*fu.READ, F.lit(n).alias("side"), fu.binned_spot().alias("spot")).select(*fu.READ, "side", "spot.*") for n, df in (("p", p), ("s", fu.named_places(p))))
        return a.unionByName(b)

    pairs = by_read(states.SPOT, states.pair_changes, states.PAIR_CHANGE, states.PAIR_STATE, ends)
    monkeypatch.setattr(st, "_with_state", None)
    out = scratch_path(spark, "o")
    st.stream_fusion_tags(arrivals(spark, batches), panel(spark), f"{out}/t", scratch_path(spark, "c"))
    st.stream_breakpoint_clusters(arrivals(spark, batches), panel(spark), f"{out}/p", scratch_path(spark, "c"))
    for name, want, kind in (("t", tags, states.TAG_CHANGE), ("p", pairs, states.PAIR_CHANGE)):
        assert want and sorted(map(tuple, spark.read.schema(kind).parquet(f"{out}/{name}/changes").drop("batch_id").collect()), key=str) == want


def test_arriving_alignments_are_whole_and_dealt_by_place(spark, tmp_path, monkeypatch):
    """Files of a stream of fusions hold every row, with the columns in use only, and the rows of most reads lie in several."""
    monkeypatch.setattr(stream_queries, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    place = F.col("id") % 700
    made = {"sample_id": F.lit("s"), "read_id": (F.col("id") / 4).cast("int").cast("string"), "chrom": F.lit("chr1"), "sa": F.when(place > 3, F.lit("x")), "qs": F.lit(12.0), "strand": F.lit("+")}
    made |= {c: place for c in ("ref_start", "ref_end", "mapq", "read_start", "read_end")} | {c: place == 1 for c in ("is_unmapped", "is_secondary", "is_supplementary")}
    rows = spark.range(2000).withColumns(made).drop("id").withColumns({"cigar": F.lit("9M"), "rg": F.lit("run")})
    view = SimpleNamespace(spark=spark, alignments=rows.unionByName(rows.limit(5)))
    stream = stream_queries.arriving_alignments(view)
    files = spark.read.parquet(f"{tmp_path}/arriving")
    assert stream.columns == files.columns == stream_queries.FUSION
    assert files.exceptAll(view.alignments.select(*files.columns)).isEmpty() and files.count() == 2005
    spread = files.select("read_id", F.input_file_name().alias("f")).distinct().groupBy("read_id").count()
    assert spread.filter("count > 1").count() > 450
