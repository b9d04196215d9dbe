"""Operators on text: edge cases and comparison with brute force."""

import hashlib
import math
import re
import zlib
from html import unescape

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from strandline.llm import common, exact_dedup, html_text, language, near_dedup, pieces, pii, toxicity
from strandline.llm.common import documents

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _rid string, score double, doc string, row int"
LONG = "word and more " * 20_000
EDGE = [
    (1, "a b c d", "en", "s", 1, True, "x", 0.0, "d", 1), (2, "a  b\nc d", "en", "s", 1, True, "x", 0.0, "d", 1), (2, "a  b\nc d", "en", "s", 1, True, "x", 0.0, "d", 1), (3, None, None, None, None, None, None, None, None, None),
    (4, "", "en", "s", 0, False, None, None, None, None), (5, " \t", "en", None, 0, False, None, None, None, None), (None, "a b c e", "en", "s", 0, False, None, None, None, None), (6, LONG, "en", "s", 0, False, None, None, None, None),
    (7, LONG + "x", "de", "t", 0, False, None, None, None, None), (8, "Ä ö 漢字 😀", "de", "t", 0, False, None, None, None, None),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF)


def no_space(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("block, key", [(256, F.xxhash64), (3, lambda c: F.length(c).cast("long"))])
def test_exact_duplicates_of_edge_cases(edge, block, key):
    rows = exact_dedup.exact_duplicates(edge, block, key).collect()
    assert len(rows) == len(EDGE)
    groups = {}
    for r in EDGE:
        groups.setdefault(no_space(r[1]), []).append(r)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for sha, g in by_sha.items():
        got = [r for r in rows if r.text_sha256 == sha]
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        assert len(got) == len(g) and {r.keep_id for r in got} == {best} and {r.group_size for r in got} == {len(g)} and sum(r.kept for r in got) == 1


def test_exact_duplicates_equal_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = [d[0] for d in con.execute(exact_dedup.SQL).description]
    want = sorted(con.execute(exact_dedup.SQL).fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in exact_dedup.exact_duplicates(docs).collect()) == want


def test_dropping_keeps_rows_and_columns(edge, empty):
    for drop in (exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates):
        assert drop(edge).columns == edge.columns and drop(empty).collect() == []
    kept = exact_dedup.drop_exact_duplicates(edge).collect()
    assert sorted(no_space(r.text) for r in kept) == sorted({no_space(r[1]) for r in EDGE})
    assert len([r for r in kept if r.doc_id == 2]) == 1 and next(r for r in kept if r.doc_id == 2)._rid == "x"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    ids = list(prints)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(docs):
    prints = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    component = slow_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", component[i]) for i, p in prints.items()}


def test_lookups_of_fingerprints_are_not_broadcast(spark):
    """A small file of fingerprints becomes many look-ups, so its size must not decide on a broadcast."""
    table = common.stored(spark.range(5000).select(F.xxhash64("id").alias("_fp")), "few-prints")
    pairs = near_dedup.linked_fingerprints(table)
    pairs.collect()
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_names_of_blocks_are_not_broadcast(spark, docs, monkeypatch):
    plans = []

    def kept(df, label):
        if label == "block-pairs":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.stored(df, label)

    monkeypatch.setattr(exact_dedup, "stored", kept)
    exact_dedup.exact_duplicates(docs)
    assert len(plans) > 2 and not any("BroadcastExchange" in p for p in plans)


def test_near_duplicates_of_edge_cases(edge, empty):
    rows = near_dedup.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4, 5)} == {"0" * 16} and {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    assert near_dedup.near_duplicates(empty).collect() == []


def test_fingerprints_link_up_to_three_bits(spark):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    near = [b ^ int(sum(1 << int(i) for i in rng.choice(63, k, replace=False))) for b in base for k in (1, 2, 3, 4)]
    values = sorted(set(base + near))
    table = spark.createDataFrame([(v,) for v in values], "_fp long")
    got = {tuple(sorted(r)) for r in near_dedup.linked_fingerprints(table).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


PII = [
    "mail a.b+c@x-y.example.com, d@e@f.gh and @k.lm", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 0001.002.03.4", "4111 1111 1111 1111 and 4111111111111112 5500-0000-0000-0004.", "+1 (826) 555-4081 and +12 and +1 22222222222222222",
    "", None, "9" * 5000 + " " + "0" * 6000 + ".1.2.3", "a" * 50_000 + "@" + "b." * 20_000 + "c", "+" + "(" * 50_000, "1-" * 40_000 + "1", "write to me (at) example (dot) com or call 030 123 4567", "@" * 20_000,
]


def slow_base(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            fine = {"email": lambda: True, "ip": lambda: all((x.lstrip("0") or "0") in BYTES for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in double) % 10 == 0, "phone": lambda: 8 <= len(digits) <= 15}
            if fine[kind]():
                yield kind, m.start(), m.end()


BYTES = {str(i) for i in range(256)}


def test_personal_data_equals_the_patterns(spark, docs):
    rows = [(i, t) for i, t in enumerate(PII)]
    cases = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    texts = dict(rows)
    for frame, source in ((cases, texts), (docs, {r.doc_id: r.text for r in docs.collect()})):
        got = pii.spans_by_document(frame).collect()
        assert len(got) == len(source)
        for r in got:
            text = source[r.doc_id] or ""
            if len(text) > 30_000 and "@" in text and text[0] in "a@":
                assert r.n_email == (1 if text[0] == "a" else 0)  # the plain pattern takes minutes here
                continue
            base = list(slow_base(text))
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    assert pii.spans_by_document(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_labelers_are_weighed_by_agreement():
    votes = np.array([[1, 1, 1], [0, 0, 0], [1, 1, 0], [0, 0, 1]])
    p, right = pii.expectation_maximisation(votes, np.array([400.0, 400.0, 100.0, 100.0]))
    assert p[0] > 0.9 and p[1] < 0.1 and p[2] > 0.5 and p[3] < 0.5
    assert right[2] < right[0] and right[2] < right[1]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_of_held_out_rows(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == held(r.doc_id) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)
    assert all(r.lang_pred in ("de", "en", "es", "fr", "und") for r in rows)


def test_language_of_edge_cases(edge, empty, spark):
    rows = language.identify(edge).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        if r.doc_id in (3, 4, 5):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert not next(r for r in rows if r.doc_id is None).held_out
    assert language.identify(empty).collect() == []
    unknown = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language.identify(unknown).collect()] == [("und", 0.0, True)]
    assert language.drop_rejected(edge).columns == edge.columns


def test_language_of_long_and_repeated_rows_only(spark):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    # French texts are long ones only; most German rows repeat one id and text.
    french = docs.filter("lang = 'fr'").withColumn("text", F.concat_ws(" ", F.lit("du texte " * 3), F.expr("repeat(text || ' ', cast(ceil(25000 / length(text)) as int))")))
    german = docs.filter("lang = 'de'")
    one = german.filter(language.learnable(F.col("doc_id"))).limit(1).select("doc_id", "text", "lang", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("col")
    mixed = docs.filter("lang in ('en', 'es')").unionByName(french).unionByName(german).unionByName(one)
    rows = language.identify(mixed).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("fr", "de"):
        own = [r for r in rows if r.lang == lang]
        assert sum(r.lang_pred == lang for r in own) >= 0.9 * len(own) > 0


def test_an_unlearned_language_is_rejected(spark):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    without = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    rows = language.identify(without).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    of = lambda german: [r.rejected for r in rows if (r.lang == "de") == german]
    assert sum(of(True)) >= 0.7 * len(of(True)) > 0 and sum(of(False)) <= 0.02 * len(of(False))


def test_language_is_learned_from_training_rows_only(spark):
    docs = documents(spark, "/root/testdata/sf0.01").limit(300)
    lied = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert sorted(language.identify(lied).collect(), key=str) == sorted(language.identify(docs).collect(), key=str)


def test_language_limits_take_whole_texts(spark):
    words, other = "the cat sat on the mat and ", "zyx wvu tsr qpo nml "
    rows = [("en", words * 60 + other * n) for n in range(10, 40)] + [("de", "7" * 2000 + words * 3 + "8" * n) for n in range(30)]
    cells, counts = language.ngram_counts(words * 60)
    centroid = np.zeros((1, language.CELLS), dtype=np.float32)
    centroid[0, cells] = np.log1p(counts)
    centroid = language._unit(centroid)
    for lang, size in (("en", 12), ("de", 7)):
        table = spark.createDataFrame([r for r in rows if r[0] == lang], "_lang string, _text string").repartition(3)
        least = language._least(table, np.ones(language.CELLS, dtype=np.float32), {lang: centroid})
        found = [language.ngram_counts(text) for kind, text in rows if kind == lang]
        assert all(language._length_class(c.sum()) == size for _, c in found)
        cosines = sorted(int(np.clip(language._unit(np.log1p(c.astype(np.float32))) @ centroid[0, i], 0, 1) * language.STEPS) for i, c in found)
        assert abs(least[size] * language.STEPS - np.percentile(cosines, 1)) <= 1


def test_language_model_takes_every_training_row(spark):
    """Frequencies, centroids and limits change with any one row, and not with the partitions."""
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    model = language.fit(docs)
    again = language.fit(docs.repartition(7))
    assert (model.centroids == again.centroids).all() and (model.least == again.least).all() and (model.idf == again.idf).all()
    rare = docs.filter(language.learnable(F.col("doc_id")) & (F.length("text") > 100)).groupBy("lang").agg(F.min(F.struct(F.xxhash64("text"), "doc_id")).alias("m"), F.max(F.struct(F.xxhash64("text"), "doc_id")).alias("z"))
    first = rare.filter("lang = 'en'").first()
    for doc_id in (first.m.doc_id, first.z.doc_id):
        other = language.fit(docs.filter(F.col("doc_id") != doc_id))
        assert other.centroids.shape != model.centroids.shape or (other.centroids != model.centroids).any()


@pytest.mark.parametrize("text", ["", "12 3", "a", "ab 1", "Der Fuß, l'été. " * 3, "x" * 5000, "mot " * 900, ". a.b!! c", "\u0130stanbul \u039f\u0394\u039f\u03a3 " * 50, "\U00010400a\ud800b"])
def test_cuts_of_a_text_are_counted_in_one_pass(text):
    """The n-grams of each cut equal those of the cut text on its own, blanks at its end included."""
    size, cell, count = language.prefix_counts(text)
    for i, (least, cut) in enumerate(zip(language.SIZES, language.CUTS, strict=True)):
        alone = language.ngram_counts(text[:cut])
        want = {} if alone is None or alone[1].sum() + 1 < 2 ** (least - 1) else dict(zip(*alone, strict=True))
        assert dict(zip(cell[size == i], count[size == i], strict=True)) == want


def test_toxicity_of_held_out_rows(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    out = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, y, _ in out if y == 1], [s for s, y, _ in out if y == 0]
    area = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(rows) == docs.count() and area > 0.8 and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_of_edge_cases(edge, empty, spark):
    marks = "doc_id long, toxic int, score string"
    labels = spark.createDataFrame([(1, 0, ""), (2, 1, ""), (2, 0, ""), (6, None, ""), (None, 1, ""), (7, 9, "")], marks)
    rows = toxicity.toxicity(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(empty, labels).collect() == []
    assert {r.score for r in toxicity.toxicity(edge, spark.createDataFrame([], marks)).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(edge, spark.createDataFrame([(1, 1, "")], marks)).collect()} == {1.0}


def test_toxic_words_that_are_each_rare_or_begin_with_an_accent():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("etaoinsrh"), rng.integers(2, 8)))
    text = lambda *marks: " ".join(np.insert([word() for _ in range(60)], 30, marks).tolist())
    known, rare = lambda: text("trash", "trash"), lambda: text("êpoux" + word(), "êpoux" + word())
    toxic = [known() for _ in range(100)] + [rare() for _ in range(100)]
    model = toxicity.train(toxic + [text() for _ in range(600)], [1] * 200 + [0] * 600)
    assert np.mean([toxicity.score(rare(), model) >= 0.5 for _ in range(50)]) > 0.8
    assert np.mean([toxicity.score(text(), model) >= 0.5 for _ in range(50)]) < 0.2


def test_a_long_row_leaves_the_rest_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LABEL_CHARS", 600)
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: sorted(map(len, texts)))
    for long in (1, 2, 3):
        docs = spark.createDataFrame([(i, f"{i:010d}" * (100 if i == long else 1)) for i in range(40)], "doc_id long, text string")
        want = docs.filter(toxicity.learnable(F.col("doc_id")) & (F.length("text") == 10)).count()
        assert toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic"))) == [10] * want


def test_pieces_equal_the_reference_encoder(spark, docs, edge, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    for frame in (docs, edge):
        texts = sorted(((r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()), key=str)
        got = sorted(pieces.encoded(spark, frame).collect(), key=lambda r: str((r.doc_id, pieces.decode(np.array(r.ids), PIECES))))
        assert [(r.doc_id, r.ids) for r in got] == [(i, model.encode(t)) for i, t in texts]
        assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert pieces.encoded(spark, empty).collect() == []


VOCABULARY = pieces.load()
PIECES = pieces.piece_bytes(VOCABULARY)


@pytest.mark.parametrize("remembered", [0, 500_000])
def test_pieces_of_odd_texts(monkeypatch, remembered):
    monkeypatch.setattr(pieces, "REMEMBERED", remembered)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rng = np.random.default_rng(3)
    texts = ["", " ", "  a   b", "\n\n", "x▁y", "<s>", "\x00\x01", "😀🤖", "日本語", " " * 50, "the" * 400] + ["".join(rng.choice(list("ab  \n.,etshzñé1\t(▁ion"), rng.integers(1, 80))) for _ in range(500)]
    encoder = pieces.Encoder(VOCABULARY)
    for part in (texts, texts[::-1]):
        ids = encoder.encode(part)
        assert [i.tolist() for i in ids] == [model.encode(t) for t in part]
        assert [pieces.decode(i, PIECES) for i in ids] == [t.replace("▁", " ") for t in part]


PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a></ul></nav>
<div class="cookie-notice">We use cookies here, many of them</div><div id="wrap"><h1>Title &amp; more</h1><div class="body"><p>First paragraph of the text, long enough to count,
with <a href="x">one link</a> in it.<p><b>Second</b> paragraph&nbsp;here <br>goes on and on.<ul><li>item one<li>item two</ul></div></div>
<aside>Other things to read</aside><form><p>Your name</p></form><div id="comments"><p>I liked this very much, thank you for it, truly.</p></div><script>if (a < b) document.write("</p><p>no</p>")</script><footer>&copy; us</footer>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst paragraph of the text, long enough to count, with one link in it.\n\nSecond paragraph here goes on and on.\n\nitem one\n\nitem two"


SENTENCE = "The quick survey of the river found that many of its banks had moved since anyone measured them with care. "
MENU = '<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now.</div>'


def paragraphs(n, name=""):
    return [f"{name} {i} {SENTENCE}{SENTENCE}".strip() for i in range(n)]


def marked(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


A, B = paragraphs(4, "first"), paragraphs(3, "second")


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<article>{marked(A)}</article><article>{marked(B)}</article>", A + B),
        (f"<div><article>{marked(A)}</article></div><div><article>{marked(B)}</article></div>", A + B),
        (f"<article>{marked(A)}</article><div>{marked(B)}</div>", A + B),
        (f'<article>{marked(B)}<section class="legal-notice-analysis">{marked(A)}</section></article>', B + A),
        (f"<div>{marked(A)}</div>", A),
        (f'<article>{marked(B)}<div class="comments-list">{marked(A)}</div></article>', B),
        (f'<article>{marked(A)}</article><section id="comments"><article class="comment">{marked(B)}</article></section>', A),
        (f'<article>{marked(A)}</article><article class="comment">{marked(B)}</article>', A),
        (f"<article>{marked(A)}</article><article><h3><a href=/x>More of this</a></h3><p>Short text.</p></article>", A),
        (f"<article>{marked(A)}</article><div>{SENTENCE}</div>", A),
    ],
)
def test_density_keeps_all_of_the_article_and_nothing_beside_it(body, want):
    assert html_text.main_text(f"<html><body>{MENU}{body}<footer>end</footer></body></html>").split("\n\n") == [t.strip() for t in want]


def test_density_sums_equal_a_written_out_version(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").limit(10).collect():
        page = html_text.parse(r.html)
        live = [i for i in range(len(page.tag)) if not page.cut[i]]
        up = lambda i: [i] + (up(page.parent[i]) if i else [])
        text = {i: sum(len(re.sub(r"\s", "", t)) for j, t in page.tokens if t and j == i) for i in live}
        under = {i: [j for j in live if i in up(j)] for i in live}
        is_link = {i: any(page.tag[j] == "a" for j in up(i)) for i in live}
        share = sum(text[j] for j in live if is_link[j]) / max(sum(text.values()), 1)
        density = {}
        for i in live:
            c, lc = sum(text[j] for j in under[i]), sum(text[j] for j in under[i] if is_link[j])
            t, lt = max(len(under[i]) - 1, 1), sum(is_link[j] for j in under[i] if j != i)
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e) + math.e - 1
            density[i] = max(0.0, c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1e-9)) / math.log(base)) if lc < c else 0.0
        got, sums = html_text.densities(page)
        assert all(got[i] == pytest.approx(density[i]) for i in live)
        assert all(sums[i] == pytest.approx(sum(density[j] for j in live if j and page.parent[j] == i)) for i in live)


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("plain < text", "plain < text"), ("<p>a", "a"), ("<nav><a href=x>m</a></nav>", ""), ("<script>a", ""), ('<a href="x', ""), ("<!-- a", ""), ("</p></div>b", "b")])
def test_main_text_of_broken_pages(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", '<a "' * 50_000, "<" * 100_000, "<p><b>" * 20_000 + "y"])
def test_main_text_of_hostile_pages_ends(html):
    html_text.main_text(html)


WORDS = "Words of the text go on and on, and then on again. " * 9


@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'><article>%s</article></div>", "<div class='has-sidebar'>%s</div>", "<section id='search-results'>%s</section>", "<form action='/x'>%s</form>"])
def test_wrappers_keep_their_text(wrapper):
    page = "<body><nav><a href=x>Menu</a></nav>" + wrapper % f"<p>{WORDS}</p><div class='sidebar'><p>Others.</p></div>" + "<div class='share'>Share it</div></body>"
    assert html_text.main_text(page) == WORDS.strip()


def test_long_comments_beside_an_article_are_cut():
    page = f"<body><article><p>{WORDS}</p></article><div id='comments'><p>{'I liked it. ' * 60}</p></div></body>"
    assert html_text.main_text(page) == WORDS.strip()


def test_pages_keep_their_rows(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") :].split("</article>")[0].split("<footer")[0]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    odd = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(odd).collect()) == [("", 0), ("", 0), ("x", 1)]
