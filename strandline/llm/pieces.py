"""SentencePiece encoding and decoding by matching a vocabulary against a suffix array.

The distinct words of a batch form one text. Its suffixes are sorted, and a binary
search finds the range of suffixes that start with each piece: all places of the
piece. These edges, sorted by where they end, are relaxed: an edge takes the place
behind the token before it if the pair of tokens stands, that is, if merging their
joined text gives the two again. For merge models one token can stand at each place
at most, so one pass gives the encoding that merging from characters gives.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import small_batches, text_of

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark of a blank, which begins words.
BLANK = "▁"
#: Words whose encoding a worker remembers between batches, code points of texts cut into words at once, and of new words matched at once.
REMEMBERED, TEXT_CHARS, NEW_CHARS = 300_000, 1_500_000, 250_000
#: A word begins at a blank; a line end, which no piece holds, stands alone.
WORDS = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")
NONE, START = -1, -2
PAIR_BITS = 22


@dataclass
class Vocabulary:
    """Pieces that merging can reach, their scores, and the ids of single bytes."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    kinds: list[int]
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 0}

    def merged(self, text: str) -> list[str]:
        """Merges of characters in order of score, ties from the left: the definition, for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.scores[j] > best):
                    best, at = self.scores[j], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


def load(path: str = MODEL_PATH) -> Vocabulary:
    """Reads a model file on the driver; tasks get the vocabulary, not the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = [2 if model.is_byte(i) else 1 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in range(n)]
    pieces = [model.id_to_piece(i) for i in range(n)]
    byte_ids = [-1] * 256
    for i in range(n):
        if kinds[i] == 2:
            byte_ids[int(pieces[i][3:5], 16)] = i
    if min(byte_ids) < 0 or any(BLANK in p[1:].lstrip(BLANK) or "\n" in p for p, k in zip(pieces, kinds, strict=True) if k == 0):
        raise ValueError("a model with byte pieces, and pieces that hold blanks only before other characters, is needed")
    return Vocabulary(pieces, [model.get_score(i) for i in range(n)], byte_ids, kinds)


class Encoder:
    """Encodes words in batches; remembers frequent ones and which pairs of tokens stand."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        usable = [i for i, k in enumerate(v.kinds) if k == 0 and (len(v.pieces[i]) == 1 or v.merged(v.pieces[i]) == [v.pieces[i]])]
        chars = sorted({c for i in usable for c in v.pieces[i]})
        # 0 ends words, 1 is any character that no piece holds.
        self.code = np.ones(0x110000, dtype=np.int64)
        for n, c in enumerate(chars):
            self.code[ord(c)] = n + 2
        single = {v.pieces[i] for i in usable if len(v.pieces[i]) == 1}
        self.alone = np.array([chr(c) not in single for c in range(0x110000)])
        self.bits = max(1, int(len(chars) + 2).bit_length())
        self.per = 62 // self.bits
        self.length = np.ones(len(v.pieces) + 0x110000, dtype=np.int64)
        for i in usable:
            self.length[i] = len(v.pieces[i])
        self.packs = -(-int(self.length[: len(v.pieces)].max()) // self.per)
        usable.sort(key=lambda i: v.pieces[i])
        self.usable = np.array(usable, dtype=np.int64)
        full = (1 << self.bits) - 1
        width = self.packs * self.per
        low = np.zeros((len(usable), width), dtype=np.int64)
        for r, i in enumerate(usable):
            low[r, : self.length[i]] = self.code[[ord(c) for c in v.pieces[i]]]
        past = np.arange(width) >= self.length[self.usable][:, None]
        self.low, self.high = self._packed(low), self._packed(np.where(past, full, low))
        self.pair_keys = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.pair_stands = np.zeros(1 << PAIR_BITS, dtype=bool)
        self.known: dict[str, bytes] = {}

    def _packed(self, codes: np.ndarray) -> np.ndarray:
        """Codes of fixed width as ``packs`` numbers a row that sort like the codes."""
        shifts = self.bits * np.arange(self.per - 1, -1, -1)
        return (codes.reshape(len(codes), self.packs, self.per) << shifts).sum(axis=2)

    def suffix_array(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order of their first ``packs * per`` codes, and the packed codes at each place."""
        n = len(codes)
        padded = np.concatenate((codes, np.zeros(self.packs * self.per, dtype=np.int64)))
        pack = np.zeros(n + (self.packs - 1) * self.per, dtype=np.int64)
        for j in range(self.per):
            pack = (pack << self.bits) | padded[j : j + len(pack)]
        order = np.argsort(pack[:n], kind="stable")
        key, reach = pack[:n], self.per
        while True:
            ordered = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
            if reach >= self.packs * self.per:
                return order, pack
            key = rank * (n + 1)
            key[: max(0, n - reach)] += rank[reach:] + 1
            order = np.argsort(key, kind="stable")
            reach *= 2

    def _bound(self, order: np.ndarray, pack: np.ndarray, sought: np.ndarray, right: bool) -> np.ndarray:
        """For each packed piece, how many suffixes lie before it (``right``: before or at it)."""
        lo, hi = np.zeros(len(sought), dtype=np.int64), np.full(len(sought), len(order), dtype=np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            less = np.zeros(len(sought), dtype=bool)
            equal = np.ones(len(sought), dtype=bool)
            for j in range(self.packs):
                here = pack[at + j * self.per]
                less |= equal & (here < sought[:, j])
                equal &= here == sought[:, j]
            before = less | equal if right else less
            lo = np.where(open_ & before, mid + 1, lo)
            hi = np.where(open_ & ~before, mid, hi)
        return lo

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every place of every piece."""
        order, pack = self.suffix_array(codes)
        present = np.zeros(1 << self.bits, dtype=bool)
        present[codes] = True
        first = self.low[:, 0] >> (self.bits * (self.per - 1))
        some = np.flatnonzero(present[first])
        lo = self._bound(order, pack, self.low[some], False)
        hi = self._bound(order, pack, self.high[some], True)
        count = hi - lo
        total = int(count.sum())
        within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        return order[np.repeat(lo, count) + within], np.repeat(self.usable[some], count)

    def _stands(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is what merging its joined text gives."""
        n = len(self.vocabulary.pieces)
        keys = first * n + second
        slot = (keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> (64 - PAIR_BITS) & ((1 << PAIR_BITS) - 1)
        hit = self.pair_keys[slot] == keys
        out = self.pair_stands[slot] & hit
        if not hit.all():
            missing, back = np.unique(keys[~hit], return_inverse=True)
            pieces, merged = self.vocabulary.pieces, self.vocabulary.merged
            made = np.fromiter(((lambda a, b: merged(a + b) == [a, b])(pieces[k // n], pieces[k % n]) for k in missing.tolist()), dtype=bool, count=len(missing))
            out[~hit] = made[back]
            slot = (missing * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> (64 - PAIR_BITS) & ((1 << PAIR_BITS) - 1)
            self.pair_keys[slot], self.pair_stands[slot] = missing, made
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in a row, and how many each has; a character without a piece has its code point above the ids."""
        n = len(self.vocabulary.pieces)
        points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        codes = self.code[points]
        codes[ends] = 0
        begin, token = self.edges(codes)
        lone = np.flatnonzero(self.alone[points])
        lone = lone[~np.isin(lone, ends)] if len(lone) else lone
        begin, token = np.concatenate((begin, lone)), np.concatenate((token, points[lone] + n))
        word_of = np.repeat(np.arange(len(words)), sizes + 1)
        finish = begin + self.length[token]
        offset = finish - starts[word_of[begin]]
        order = np.argsort(offset, kind="stable")
        begin, token, finish, offset = begin[order], token[order], finish[order], offset[order]
        last = np.full(len(points) + 1, NONE, dtype=np.int64)
        last[starts] = START
        cuts = np.flatnonzero(np.concatenate(([True], offset[1:] != offset[:-1], [True]))) if len(offset) else np.zeros(1, dtype=int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            before, now, to = last[begin[a:b]], token[a:b], finish[a:b]
            good = (before == START) | ((before >= 0) & ((before >= n) | (now >= n)))
            both = np.flatnonzero((before >= 0) & (before < n) & (now < n))
            good[both] = self._stands(before[both], now[both])
            last[to[good]] = now[good]
        # Back from the ends of the words; each round gives one token of each word that has more.
        at, word = ends.copy(), np.arange(len(words))
        places, tokens, owners = [], [], []
        while True:
            more = at > starts[word]
            at, word = at[more], word[more]
            if not len(at):
                break
            t = last[at]
            if (t < 0).any():
                raise RuntimeError(f"no encoding of {words[int(word[np.flatnonzero(t < 0)[0]])]!r} was found")
            at = at - self.length[t]
            places.append(at)
            tokens.append(t)
            owners.append(word)
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        places, tokens, owners = map(np.concatenate, (places, tokens, owners))
        return tokens[np.argsort(places, kind="stable")], np.bincount(owners, minlength=len(words))

    def _spelled(self, tokens: list[int]) -> bytes:
        """Ids of a word as 32-bit numbers; characters without a piece become the ids of their UTF-8 bytes."""
        n, ids = len(self.vocabulary.pieces), []
        for t in tokens:
            ids += [t] if t < n else [self.vocabulary.byte_ids[b] for b in chr(t - n).encode("utf-8", "replace")]
        return np.array(ids, dtype="<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts, some texts at a time. Null and empty texts have none."""
        out: list[np.ndarray] = []
        some: list[str] = []
        size = 0
        for text in texts:
            some.append((BLANK + text.replace(" ", BLANK)) if text else "")
            size += len(some[-1])
            if size >= TEXT_CHARS:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [WORDS.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        fresh, waiting = set(), 0
        for words in cut:
            for w in words:
                if w not in known and w not in fresh:
                    fresh.add(w)
                    waiting += len(w)
            if waiting > NEW_CHARS:
                self._learn(fresh)
                fresh, waiting = set(), 0
        self._learn(fresh)
        return [np.frombuffer(b"".join([known[w] for w in words]), dtype="<i4") for words in cut]

    def _learn(self, words: set[str]) -> None:
        ordered = sorted(words)
        if not ordered:
            return
        tokens, counts = self.encode_words(ordered)
        ends = np.cumsum(counts)
        plain = tokens.astype("<i4").tobytes()
        lone = np.zeros(len(tokens) + 1, dtype=np.int64)
        np.cumsum(tokens >= len(self.vocabulary.pieces), out=lone[1:])
        spelled = lone[ends] > lone[ends - counts]
        for w, a, b, odd in zip(ordered, (ends - counts).tolist(), ends.tolist(), spelled.tolist(), strict=True):
            self.known[w] = self._spelled(tokens[a:b].tolist()) if odd else plain[4 * a : 4 * b]


def piece_bytes(vocabulary: Vocabulary) -> list[bytes]:
    """What each id stands for; control pieces stand for nothing."""
    out = [p.encode("utf-8") if k == 0 else b"" for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]
    for b, i in enumerate(vocabulary.byte_ids):
        out[i] = bytes([b])
    return out


def decode(ids: np.ndarray, pieces: list[bytes]) -> str:
    """Text of ids: pieces joined, blanks back to spaces, without the one that encoding put before the text."""
    text = b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(BLANK, " ")
    return text[1:] if text.startswith(" ") else text


#: The encoder of this worker, by the run it was made for; it outlives tasks.
_OF_WORKER: dict[str, Encoder] = {}


def _encoder(run: str, vocabulary: Broadcast) -> Encoder:
    if run not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[run] = Encoder(vocabulary.value)
    return _OF_WORKER[run]


def encoded(spark: SparkSession, docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids, round_trip.

    Whole texts; null and empty texts have no ids. ``round_trip`` tells whether the
    ids decode to the text; the mark of blanks itself comes back as a space, as the
    model has it. Repeated rows are independent; other columns aren't read; an empty
    table gives no row. A worker remembers a bounded number of words.
    """
    small_batches(spark)
    vocabulary, this = spark.sparkContext.broadcast(load(model_path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(this, vocabulary)
        pieces = piece_bytes(encoder.vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = encoder.encode(texts)
            back = [decode(i, pieces) == t.replace(BLANK, " ") for i, t in zip(ids, texts, strict=True)]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32), type=pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), type=pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), lists, pa.array(back)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")
