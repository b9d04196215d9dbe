"""Mixing, neighbours, archives and the pipeline: edge cases and comparison with brute force."""

import io
import re
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import mixing, neighbours, queries, warc
from strandline.llm.common import documents, stored
from strandline.session import scratch_path

SF = "/root/testdata/sf0.001"


def water_level(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, left, target = set(order), share * sum(sizes.values()), {}
    while rest:
        level = left / sum(w[s] for s in rest)
        above = {s for s in rest if level * w[s] > most * sizes[s]}
        if not above:
            return target | {s: level * w[s] for s in rest}
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
        rest -= above
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def by_source(spark, docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    return rows, sizes


@pytest.mark.parametrize("weights", [(3, 1, 2), (100, 1, 1)])
def test_mix_reaches_its_targets(spark, weights):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows, sizes = by_source(spark, docs)
    targets = water_level(sizes, weights)
    source, size = {r.doc_id: r.source for r in rows}, {r.doc_id: words(r.text) for r in rows}
    got = mixing.mix(docs, weights=weights).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(size[i] for i in size if source[i] == s) / 2 + 1
    again = mixing.mix(docs.repartition(7), weights=weights).collect()
    assert sorted(again) == sorted(got)


def test_mix_of_edge_cases(spark):
    schema = "doc_id long, text string, source string, size string, copies int, doc string"
    rows = [(1, "a b", None, "x", 1, "")] + [(2, "a b c", "s", "x", 1, "")] * 5 + [(3, None, "s", "", 1, ""), (4, "", "t", "", 1, ""), (None, "a", "s", "", 1, ""), (None, "a", "s", "", 1, ""), (5, "w " * 30_000, "u", "", 1, "")]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    assert [r.taken for r in got if r.doc_id in (3, 4)] == [0, 0] and next(r.target for r in got if r.doc_id == 4) == 0
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert sum(words(r.text) for r in mixed.collect()) == sum(r.taken for r in got)
    for f in (mixing.mix, mixing.mixed_rows):
        assert f(spark.createDataFrame([], schema)).collect() == []


def test_the_draws_are_fair(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "s") for i in range(60)] + [(1000, "w " * 600, "t")], "doc_id long, text string, source string")
    want = water_level(by_source(spark, docs)[1])["s"] / sum(1 + i % 7 for i in range(60))
    mean = np.mean([[r.copies / r.rows for r in mixing.copies_of(docs, seed=s).filter("source = 's'").collect()] for s in range(6)])
    assert mean == pytest.approx(want, rel=0.1)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string, v int, dim int, block int")


def test_neighbours_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float32).astype(float)
    got = {}
    for r in neighbours.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), block=700, chunk=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        found = sorted(got[int(ids[q])])
        assert [f[0] for f in found] == list(range(1, 21)) and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        at = {int(i): k for k, i in enumerate(ids)}
        assert all(f[2] == pytest.approx(score[at[f[1]]], abs=1e-12) for f in found)
        hits.append(len({f[1] for f in found} & set(ids[np.lexsort((ids, -score))[:20]].tolist())))
    assert len(got) == int((ids % 20 == 0).sum()) and np.mean(hits) / 20 >= 0.9


def test_neighbours_of_vectors_with_different_norms(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((900, 12)) * rng.uniform(0.2, 5, (900, 1))).astype(np.float32).astype(float)
    frame = vectors(spark, [(i, x[i].tolist(), 0, "", 0, 0, 0) for i in range(900)])
    got = {}
    for r in neighbours.nearest(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, 900, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-score)[:20].tolist())))
    assert np.mean(hits) / 20 >= 0.9


def test_neighbours_of_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (20, [-1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (60, [0.0, 0.0])]
    got = neighbours.nearest(vectors(spark, [(*r, 0, "", 0, 0, 0) for r in rows])).collect()
    of = lambda q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
    assert of(0) == [(1, 1.0), (2, 1.0), (2, 1.0), (3, 0.0), (20, -1.0)]
    assert of(20) == [(3, 0.0), (0, -1.0), (1, -1.0), (2, -1.0), (2, -1.0)]
    assert of(40) == [] and of(60) == [] and {r.query_id for r in got} == {0, 20}
    assert neighbours.nearest(vectors(spark, [])).collect() == []


def test_collisions_select_few_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    index, asked = neighbours.Index(ids, x, np.ones(len(ids), dtype=int)), ids % 20 == 0
    found = list(index.search(ids[asked], x[asked], 20))
    hits = 0
    for q in np.flatnonzero(asked):
        score = np.where(ids == ids[q], -np.inf, x @ x[q])
        hits += len({i for own, i, _, _ in found if own == ids[q]} & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert index.verified <= 0.3 * asked.sum() * len(ids) and hits >= 0.95 * 20 * asked.sum()


def test_a_written_index_is_the_same():
    x = np.random.default_rng(3).standard_normal((50, 4)) * 1e300
    index, file = neighbours.Index(np.arange(50), x, np.ones(50, dtype=int)), io.BytesIO()
    index.write(file)
    file.seek(0)
    again = neighbours.Index.read(file)
    assert (again.sorted == index.sorted).all() and (np.ldexp(again.vectors, again.exponent) == x).all()


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 6))
    x[7] *= 1e200
    x[9] *= 1e-200
    x[40] *= 100
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = []
    for q in range(0, 200, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len({f[1] for f in got[q]} & set(np.argsort(-score)[:20].tolist())))
        assert all(f[2] == pytest.approx(score[f[1]], rel=1e-9) for f in got[q])
    assert np.mean(hits) / 20 >= 0.9


def test_repeated_ids_and_rows_spread_over_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(20, rng.standard_normal(4).tolist()) for _ in range(400)] + [(1, [1.0, 0.0, 0.0, 0.0])] * 400 + [(i, rng.standard_normal(4).tolist()) for i in range(2, 20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    blocks = neighbours.build(neighbours.usable(frame), block=50).collect()
    sizes = [neighbours.Index.read(neighbours._load(r.path)) for r in blocks]
    assert sum(i.copies.sum() for i in sizes) == len(rows) and max(len(i.ids) for i in sizes) < 100
    got = neighbours.nearest(frame, block=50).collect()
    best = min(r[1] for r in rows if r[0] == 20)
    want = sorted(((-float(np.dot(v, best)), i) for i, v in rows if i != 20))[:20]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [i for _, i in want]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, record_type int")


def test_archives_give_back_what_went_in(spark):
    rng = np.random.default_rng(1)
    noise = ["".join(map(chr, rng.integers(32, 1200, rng.integers(0, 4000)))) for _ in range(60)]
    rows = [(i, f"http://x/{i}?ü \r\n", noise[i % 50], "", 0) for i in range(60)] + [(100, None, None, "", 0), (101, "u", "", "", 0), (101, "u", "", "", 0), (None, "u", "alone", "", 0), (None, "u", "both", "", 0), (102, "u", "both", "", 0), (103, "u", "WARC/1.0\r\n\r\n" * 50_000, "", 0)]
    frame = pages(spark, rows).repartition(2)
    for split in (64, 1000, 1 << 20):
        back = warc.archive(spark, frame, split=split).collect()
        assert len(back) == len(rows)
        text = {}
        for r in back:
            if r.record_type == "response":
                text[r.payload_digest] = r.payload.decode()
        first = {}
        for i, _, html, *_ in rows:
            first[html or ""] = max([x for x in (first.get(html or ""), i) if x is not None], default=None)
        want = sorted(((i, len((html or "").encode()), html or "", "response" if i == first[html or ""] else "revisit", None if i == first[html or ""] else first[html or ""]) for i, _, html, *_ in rows), key=str)
        assert sorted(((r.page_id, r.payload_bytes, text[r.payload_digest], r.record_type, r.refers_to) for r in back), key=str) == want
    assert {r.record_type for r in warc.archive(spark, frame, least_bytes=10**9).collect()} == {"response"}
    assert warc.archive(spark, pages(spark, [])).collect() == []


def test_ranges_pass_over_false_magic(spark, tmp_path):
    whole = b"\x1f\x8b\x08" + bytes(50) + warc.record(1, "u", b"a" * 500, None, False) + b"\x1f\x8b\x08junk" + warc.record(2, "u", b"b" * 70_000, None, False)
    path = tmp_path / f"{uuid.uuid4().hex}.warc.gz"
    path.write_bytes(whole)
    for split in (7, 100, len(whole)):
        files = spark.createDataFrame([(f"file://{path}", len(whole))], "path string, size long")
        assert sorted((r.page_id, len(r.payload)) for r in warc.read_archives(files, split).collect()) == [(1, 500), (2, 70_000)]


@pytest.mark.parametrize("split", [1000, warc.SPLIT])
def test_archives_keep_pages_of_long_urls(spark, split):
    noise = "".join(f"{x:08x}" for x in np.random.default_rng(5).integers(0, 1 << 32, 25_000))
    urls = ["data:text/html," + noise, "http://a/" + "日本語" * 3000, "http://a/b"]
    frame = pages(spark, [(i, u, f"<p>{i}", "", 0) for i, u in enumerate(urls)])
    rows = {r.page_id: r for r in warc.archive(spark, frame, split=split).collect()}
    assert sorted(rows) == [0, 1, 2] and rows[0].url == urls[0] and {len(r.payload) for r in rows.values()} == {4}


def test_another_number_of_records_raises(spark):
    frame = warc.to_records(pages(spark, [(i, "u", f"<p>{i}" * 99, "", 0) for i in range(20)]))
    files = stored(warc.write_archives(frame, scratch_path(spark, "warc"), 500), "warc-files")
    assert all(sum(r.starts) == r.records for r in files.collect())
    assert warc.read_archives(files, 500).count() == 20
    with pytest.raises(Exception, match="records of"):
        warc.read_archives(files.withColumn("starts", F.transform("starts", lambda n: n + 1)), 500).collect()


def test_archive_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    cols = [d[0] for d in con.execute(warc.SQL).description]
    got = queries.op8_warc(spark, SF)
    assert sorted(got.columns) == sorted(cols) and sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(con.execute(warc.SQL).fetchall())


def test_pipeline_stages(spark):
    docs = documents(spark, SF)
    frame = docs.withColumn("times", F.lit(1)).withColumn("doc", F.lit("x")).withColumn("row", F.lit(2))
    before = frame.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, frame, SF), name)
        if name == "encoding":
            assert out.count() == before and out.filter("not round_trip").count() == 0
            break
        assert out.columns == frame.columns
        n = out.count()
        assert n >= 0.85 * before if name != "source_mix" else sum(words(r.text) for r in out.collect()) == pytest.approx(1.5 * sum(words(r.text) for r in frame.collect()), rel=0.1)
        if name in ("exact_dedup", "near_dedup"):
            assert n == out.select("doc_id").distinct().count()
        frame, before = out, n


def test_pipeline_of_an_empty_table(spark):
    frame = spark.createDataFrame([], documents(spark, SF).schema)
    for name, stage in corpus_pipeline.STAGES:
        frame = stored(stage(spark, frame, SF), name)
        assert frame.count() == 0


def test_every_operator_has_one_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))


def test_scratch_is_below_the_shared_folder(spark):
    assert "strandline-" in scratch_path(spark, "x")
