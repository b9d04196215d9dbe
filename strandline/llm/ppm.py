"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts, held as one table per level: level k has a row
for every k bytes of context and the byte that followed, with its count in the training
texts. A byte is coded in the longest known context; where that context never saw it, an
escape is paid and the next shorter context takes over, without the bytes that the longer
one had ruled out. A text ends with an end mark, and its context starts with end marks.

Texts are read in chunks. What a chunk needs from the model is the set of its distinct
grams (context and byte) and words, so those are what tasks exchange: counted over all
chunks, priced level by level, and sent back to the chunk that asked. A gram goes by its
bytes as a number, a word on its way back by -1 - its place among the chunk's words in
order of appearance. No task ever holds the model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import small_batches, stored, text_of
from strandline.session import scratch_path

#: Bytes of the longest context; a gram of ORDER + 1 bytes has to fit 63 bits.
ORDER = 4
#: Bytes of text that share one exchange of grams, and those coded at once.
CHUNK, SLICE = 32 << 20, 1 << 19
#: The end mark is a byte that no UTF-8 text holds; with it there are 256 symbols.
END, SYMBOLS = 0xFF, 256

TEXT, GRAM, WORD = 0, 1, 2


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 by 5; a row without id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def coded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, the end of each, and for each symbol whether it is one to code.

    Every text is preceded by ``order`` end marks, which are context only, and followed by one.
    """
    lead, mark = bytes([END]) * order, bytes([END])
    symbols = np.frombuffer(b"".join(lead + t + mark for t in texts), dtype=np.uint8)
    ends = np.cumsum([len(t) + order + 1 for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    codes = np.ones(len(symbols), dtype=bool)
    for i in range(order):
        codes[starts + i] = False
    return symbols, ends, codes


def grams(symbols: np.ndarray, codes: np.ndarray, order: int, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions, grams)`` of the symbols to code, slice by slice: the context's bytes and the symbol, oldest first."""
    for i in range(order, len(symbols), size):
        part = symbols[i - order : i + size].astype(np.int64)
        n = len(part) - order
        value = part[order:].copy()
        for j in range(1, order + 1):
            value |= part[order - j : order - j + n] << (8 * j)
        here = np.flatnonzero(codes[i : i + n])
        yield here + i, value[here]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of several ``(grams, counts)`` and their summed counts."""
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def groups(texts: list[bytes], size: int = SLICE) -> Iterator[range]:
    """Runs of texts that together hold about ``size`` bytes; a longer text is a run of its own."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        if i > first and total + len(text) > size:
            yield range(first, i)
            first, total = i, 0
        total += len(text)
    if texts:
        yield range(first, len(texts))


def chunk_grams(texts: list[bytes], learned: list[bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a chunk, sorted, and how often each occurs in its training texts."""
    done, fresh, waiting = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), [], 0
    for training in (True, False):
        mine = [t for t, flag in zip(texts, learned, strict=True) if flag == training]
        for run in groups(mine):
            symbols, _, codes = coded([mine[i] for i in run], order)
            for _, values in grams(symbols, codes, order):
                keys, counts = np.unique(values, return_counts=True)
                fresh.append((keys, counts * training))
                waiting += len(keys)
                if waiting > len(done[0]) + SLICE:
                    done, fresh, waiting = merged([done, *fresh]), [], 0
    return merged([done, *fresh]) if fresh else done


def chunk_words(texts: list[bytes], learned: list[bool]) -> Counter:
    """Words of a chunk in order of appearance and how often each occurs in its training texts; the empty word is the end of a text."""
    found: Counter = Counter()
    for text, training in zip(texts, learned, strict=True):
        words = text.split()  # of bytes: at the white space of the contract
        words.append(b"")
        found.update(words if training else dict.fromkeys(words, 0))
    return found


def read_chunks(docs: DataFrame, order: int, chunk: int) -> DataFrame:
    """One table of texts (kind 0), their distinct grams (1) and words (2), every row with its chunk.

    ``key`` is the number of a text within its chunk, the gram, or the word's place.
    """
    rows = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), (F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).alias("learned"), text_of().cast("binary").alias("text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, learned, texts, total = [], [], [], [], 0
        id_field = None

        def batch(kind, key, **columns):
            types = {"doc_id": id_field, "held_out": pa.bool_(), "text": pa.binary(), "word": pa.binary(), "n": pa.int64()}
            every = {name: columns.get(name, pa.nulls(len(key), of)) for name, of in types.items()}
            return pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(key), number)), "kind": pa.array(np.full(len(key), kind, dtype=np.int32)), "key": pa.array(key), **every})

        def emit():
            yield batch(TEXT, np.arange(len(texts)), doc_id=pa.array(ids, id_field), held_out=pa.array(held, pa.bool_()), text=pa.array(texts, pa.binary()))
            keys, counts = chunk_grams(texts, learned, order)
            yield batch(GRAM, keys, n=pa.array(counts))
            words = chunk_words(texts, learned)
            yield batch(WORD, -1 - np.arange(len(words)), word=pa.array(words.keys(), pa.binary()), n=pa.array(words.values(), pa.int64()))

        for part in batches:
            id_field = part.schema.field("doc_id").type
            for i, h, l, t in zip(part["doc_id"].to_pylist(), part["held_out"].to_pylist(), part["learned"].to_pylist(), part["text"].to_pylist(), strict=True):
                if texts and total + len(t) > chunk:
                    yield from emit()
                    ids, held, learned, texts, total = [], [], [], [], 0
                    number += 1
                ids.append(i)
                held.append(h)
                learned.append(l)
                texts.append(t.lower())  # of bytes: A to Z only
                total += len(t)
        if texts:
            yield from emit()

    found = rows.mapInArrow(split, f"chunk long, kind int, key long, doc_id {id_type}, held_out boolean, text binary, word binary, n long")
    path = scratch_path(docs.sparkSession, "ppm-chunks")
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def _suffix(gram: str, k: int) -> Column:
    """The gram with the last ``k`` bytes of its context."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))


def trie(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """Level by level from no context to ``order`` bytes: grams with counts, and contexts with what escapes need.

    A context has its number of symbols (``seen``), their counts' sum (``total``) and
    the sum of the same symbols' counts one level below (``below``), which is what
    the shorter context leaves out once this one has escaped.
    """
    levels = [counts]
    for k in range(order - 1, -1, -1):
        levels.append(stored(levels[-1].groupBy(_suffix("gram", k).alias("gram")).agg(F.sum("c").alias("c")), f"trie-{k}"))
    levels.reverse()
    nodes = []
    for k, level in enumerate(levels):
        context = F.shiftright("gram", 8).alias("context")
        if k:
            shorter = levels[k - 1].select(F.col("gram").alias("short"), F.col("c").alias("below"))
            level = level.withColumn("short", _suffix("gram", k - 1)).join(shorter, "short")
        else:
            level = level.withColumn("below", F.lit(0).cast("long"))
        nodes.append(stored(level.groupBy(context).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("seen"), F.sum("below").alias("below")), f"contexts-{k}"))
    return list(zip(levels, nodes, strict=True))


def prices(wanted: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``(gram, price)`` of every wanted gram: log10 of the symbol's probability after its context.

    In a context of ``seen`` symbols and ``total`` counts a symbol of count c has
    (2c - 1) / (2 total) and the escape has seen / (2 total), both after exclusion; a
    symbol that no level knows shares what is left of the alphabet evenly.
    """
    order = len(levels) - 1
    known, contexts = levels[order]
    at_top = known.withColumn("context", F.shiftright("gram", 8)).join(contexts, "context")
    seen = at_top.select("gram", F.log10((2 * F.col("c") - 1) / (2 * F.col("total"))).alias("price"))
    zero = F.lit(0).cast("long")
    state = wanted.join(known.select("gram"), "gram", "left_anti").select("gram", F.lit(0.0).alias("price"), F.lit(False).alias("coded"), zero.alias("out_total"), zero.alias("out_seen"))
    for k in range(order, -1, -1):
        level, nodes = levels[k]
        here = state.withColumn("at", _suffix("gram", k)).withColumn("context", F.shiftright("at", 8))
        here = here.join(nodes, "context", "left").join(level.select(F.col("gram").alias("at"), "c"), "at", "left")
        total, left = F.col("total") - F.col("out_total"), F.col("seen") - F.col("out_seen")
        open_ = ~F.col("coded") & F.col("total").isNotNull()
        step = F.when(F.col("c").isNotNull(), F.log10((2 * F.col("c") - 1) / (2 * total))).when(left > 0, F.log10(left / (2 * total))).otherwise(0.0)
        state = here.select(
            "gram", (F.col("price") + F.when(open_, step).otherwise(0.0)).alias("price"), (F.col("coded") | F.col("c").isNotNull()).alias("coded"),
            F.when(F.col("total").isNotNull(), F.col("below")).otherwise(F.col("out_total")).alias("out_total"),
            F.when(F.col("total").isNotNull(), F.col("seen")).otherwise(F.col("out_seen")).alias("out_seen"),
        )
    rest = F.when(F.col("coded"), 0.0).otherwise(F.log10(1.0 / (SYMBOLS - F.col("out_seen"))))
    return seen.unionByName(state.select("gram", (F.col("price") + rest).alias("price")))


def text_prices(texts: list[bytes], keys: np.ndarray, price: np.ndarray, order: int) -> list[float]:
    """Log10 probability of each text, from the prices of all grams of the chunk (``keys`` sorted)."""
    sums = np.zeros(len(texts))
    for run in groups(texts):
        symbols, ends, codes = coded([texts[i] for i in run], order)
        for at, values in grams(symbols, codes, order):
            if not len(values):
                continue
            distinct, place = np.unique(values, return_inverse=True)
            each = price[np.searchsorted(keys, distinct)][place]
            text = np.searchsorted(ends, at, "right")
            first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            sums[run.start + text[first]] += np.add.reduceat(each, first)
    return sums.tolist()


def text_words(texts: list[bytes], counts: list[int], scale: float) -> Iterator[tuple[int, int, float]]:
    """Tokens, known tokens and base score of each text; ``counts`` by the words' places."""
    places: dict[bytes, int] = {}
    logs = {c: math.log10((c + 0.5) / scale) for c in set(counts)}
    for text in texts:
        words = text.split()
        words.append(b"")
        mine = [counts[places.setdefault(w, len(places))] for w in words]
        yield len(mine), sum(1 for c in mine if c), math.fsum([logs[c] for c in mine])


def score(docs: DataFrame, order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    Reads doc_id and text only, so other columns may have any name. A to Z count as
    lower case for words and bytes alike. Null texts count as empty; an empty text
    has one token and one symbol, its end. Rows without id are scored and not learned
    from. Repeated rows and ids count and are scored one by one. Without any training
    text all symbols are equally likely and base_score is 0; an empty table gives an
    empty result. A text of any length is scored whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table = read_chunks(docs, order, chunk)
    gram_rows = table.filter(F.col("kind") == GRAM).select("chunk", "key", "n")
    gram_counts = stored(gram_rows.groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("c")), "ppm-grams")
    levels = trie(gram_counts.filter("c > 0"), order)
    priced = prices(gram_counts.select("gram"), levels)

    # A word has one row per chunk that holds it.
    same = Window.partitionBy("word")
    word_rows = table.filter(F.col("kind") == WORD).select("chunk", "key", "word", "n")
    counted = word_rows.select("chunk", "key", "n", F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("chunk")) == 1).alias("first"))
    words = stored(counted, "ppm-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("first") & (F.col("c") > 0), 1))).first()
    scale = total + 0.5 * (distinct + 1)

    grams_back = gram_rows.withColumnRenamed("key", "gram").join(priced, "gram").select("chunk", F.col("gram").alias("key"), F.col("price").alias("value"))
    asked = grams_back.unionByName(words.select("chunk", "key", F.col("c").cast("double").alias("value")))
    texts = table.filter(F.col("kind") == TEXT).select(F.col("chunk").alias("of"), F.col("key").alias("row"), "doc_id", "held_out", "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pa.array(np.argsort(left["row"].to_numpy())))
        body = left["text"].to_pylist()
        keys, values = right["key"].to_numpy(), right["value"].to_numpy()
        by_key = np.argsort(keys)
        keys, values = keys[by_key], values[by_key]
        n_words = int(np.searchsorted(keys, 0))
        tokens, known, base = zip(*text_words(body, values[:n_words][::-1].astype(np.int64).tolist(), scale), strict=True) if body else ((), (), ())
        return pa.table({
            "doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([total] * len(body), pa.int64()), "base_score": pa.array(base, pa.float64()),
            "score": pa.array(text_prices(body, keys[n_words:], values[n_words:], order), pa.float64()),
        })

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("of").cogroup(asked.groupBy("chunk")).applyInArrow(scored, schema)
