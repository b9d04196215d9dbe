"""Scores against a written-out trie with explicit exclusion sets, and defined edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import ppm, queries

SF = "/root/testdata/sf0.001"


def remainder(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def written_out(rows, order=ppm.ORDER):
    """Per row: n_tokens, n_known, train_tokens, base_score, score."""
    train = [lower(t) for i, t in rows if remainder(i) not in (None, 1)]
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t), None]
    counts = Counter(w for t in train for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    nodes = defaultdict(Counter)
    symbols = lambda t: [256] * order + list(t.encode()) + [256]
    for t in train:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                nodes[tuple(s[i - k : i])][s[i]] += 1

    def price(s, i):
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            node = nodes.get(tuple(s[i - k : i]))
            if node is None:
                continue
            left = {c: n for c, n in node.items() if c not in excluded}
            if s[i] in left:
                return out + math.log10((2 * left[s[i]] - 1) / (2 * sum(left.values())))
            if left:
                out += math.log10(len(left) / (2 * sum(left.values())))
            excluded |= set(node)
        return out - math.log10(256 - len(excluded))

    for _, t in rows:
        t = lower(t)
        w = words(t)
        s = symbols(t)
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        yield len(w), sum(counts[x] > 0 for x in w), total, base, sum(price(s, i) for i in range(order, len(s)))


def compare(df, rows, order=ppm.ORDER):
    found = sorted((tuple(r) for r in df.collect()), key=repr)
    wanted = sorted(((i, remainder(i) == 1, *w) for (i, _), w in zip(rows, written_out(rows, order), strict=True)), key=repr)
    assert len(found) == len(wanted)
    key = lambda r: (repr(r[:5]), round(r[6], 6))
    for a, b in zip(sorted(found, key=key), sorted(wanted, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


def test_query_agrees_with_a_written_out_trie(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    compare(queries.op12_lm_scores(spark, SF), rows)


ODD = [
    (1, "Aba aba\tabA"), (2, None), (3, ""), (None, "ab ab"), (4, "éàü 漢字 \x00 abc"), (4, "zzz"), (4, "zzz"), (5, "ABA aba x"),
    (6, "qqq unseen ζ"), (7, "abacus " * 50), (8, " \n\x0b "), (9, "\x1f"), (11, "ab"), (12, "xyx"), (13, "aba"), (14, "aba ab"), (15, "k"),
]


@pytest.mark.parametrize(("order", "chunk"), [(0, 10), (1, 1), (4, 30), (6, 1 << 20)])
def test_nulls_repeats_and_small_chunks(spark, order, chunk):
    df = spark.createDataFrame([(t, i, 1, "x") for i, t in ODD], "text string, doc_id long, chunk int, gram string")
    assert {remainder(i) for i, _ in ODD} >= {0, 1, 2}
    compare(ppm.score(df.repartition(3), order, chunk), ODD, order)


def test_slices_end_anywhere(monkeypatch):
    import numpy as np

    texts = [b"abcabcd", b"", b"abcx" * 9]
    symbols, ends, codes = ppm.coded(texts, 3)
    whole = list(ppm.grams(symbols, codes, 3))
    cut = list(ppm.grams(symbols, codes, 3, size=4))
    for i in (0, 1):
        assert np.concatenate([p[i] for p in cut]).tolist() == np.concatenate([p[i] for p in whole]).tolist()
    assert len(np.concatenate([p[0] for p in whole])) == sum(len(t) + 1 for t in texts) and ends[-1] == len(symbols)


def test_probabilities_add_up_to_one(spark):
    """Over all symbols after each of several contexts: known, known in part, unknown."""
    rows = [(i, t) for i, t in enumerate(["abracadabra", "abrakadabra", "cadabra abra", "dabra"], 20) if remainder(i) not in (None, 1)]
    counts, top = Counter(), 2
    for _, t in rows:
        symbols, _, codes = ppm.coded([t.encode()], top)
        counts.update(v for _, values in ppm.grams(symbols, codes, top) for v in values.tolist())
    levels = ppm.trie(spark.createDataFrame(list(counts.items()), "gram long, c long"), top)
    contexts = [(97 << 8) | 98, (120 << 8) | 97, (120 << 8) | 121]
    wanted = spark.createDataFrame([((c << 8) | s, c) for c in contexts for s in range(256)], "gram long, context long")
    sums = wanted.join(ppm.prices(wanted.select("gram"), levels), "gram").groupBy("context").agg(F.sum(F.pow(F.lit(10.0), "price")).alias("p"), F.count("price").alias("n"))
    found = {r.context: (r.p, r.n) for r in sums.collect()}
    assert set(found) == set(contexts) and all(n == 256 and p == pytest.approx(1, abs=1e-9) for p, n in found.values())


def test_nothing_to_learn_from(spark):
    alone = [(i, "abc") for i in range(200) if remainder(i) == 1][:2]
    got = ppm.score(spark.createDataFrame(alone, "doc_id long, text string")).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.score == pytest.approx(-4 * math.log10(256)) for r in got) and len(got) == 2
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_held_out_text_of_the_corpus_beats_its_letters_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = [r for r in docs.collect() if remainder(r.doc_id) == 1 and r.text and 200 < len(r.text) < 5000]
    mixed = [(r.doc_id, "".join(sorted(r.text))) for r in held]
    real = {r.doc_id: r.score for r in ppm.score(docs).collect()}
    odd = docs.join(spark.createDataFrame(mixed, "doc_id long, other string"), "doc_id", "left").select("doc_id", F.coalesce("other", "text").alias("text"))
    worse = {r.doc_id: r.score for r in ppm.score(odd).collect()}
    assert held and all(real[r.doc_id] > worse[r.doc_id] for r in held)
