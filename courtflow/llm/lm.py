"""Language-model scores: the marginal probability of a text over all subword segmentations.

A word's lattice has an arc for every piece of an existing subword vocabulary
that matches, weighted by the piece's probability. The vocabulary's own scores
give these: a unigram file's scores are log probabilities; a file that only ranks
its pieces (whole numbers, best first) gets the probabilities of Zipf's law by
rank. Training words move the weights by expectation-maximization over all
segmentations, with the vocabulary's as prior; the score under the vocabulary's
own weights is given beside. A forward recursion in log space sums all ways to
spell a word; a word closes with a stop, and a stop without a spelling is the end
of the text. Pieces don't cross white space, so a text's probability is the
product of its words' and its end's, and the probabilities of all texts sum to
one at most.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, rows_of, words_of

_SPACE = "▁".encode()
_WORD = pa.schema([("word", pa.binary()), ("train", pa.int64()), ("total", pa.int64())])
_PIECE = pa.schema([("piece", pa.int32()), ("n", pa.float64())])
_LAT = pa.schema([*_WORD, ("own", pa.float64()), ("lattice", pa.float64())])
_PART = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.binary()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("own", pa.float64()), ("score", pa.float64())])
_MUL = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces as bytes with their own probabilities; one hash table for each length in bytes.

    ``starts`` marks pieces that open with the word mark: they match at a word's
    start only. The last entry of ``prior`` is the stop that closes a word.
    ``heads`` marks the first 16 bits of each table's hashes: few places that hold
    no piece pass it to be looked up.
    """

    pieces: list[bytes]
    prior: np.ndarray
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    heads: dict[int, np.ndarray]
    starts: np.ndarray

    @property
    def stop(self) -> int:
        return len(self.pieces)


def _hash(a: np.ndarray) -> np.ndarray:
    """Hash of each row of a byte matrix; the same recursion as in ``Lattice``."""
    h = np.zeros(len(a), np.uint64)
    with np.errstate(over="ignore"):
        for c in a.T:
            h = (h + c + np.uint64(1)) * _MUL
    return h


def make_vocabulary(scored: list[tuple[bytes, float]], stop: float = 0.25) -> Vocabulary:
    """From (piece, score): probabilities by the scores, of which ``stop`` goes to the stop.

    Every byte can be spelled, so no text has probability zero: bytes that the
    vocabulary lacks, or has no score for, get the least of its pieces' weights.
    """
    seen: dict[bytes, float] = {}
    for p, s in scored:
        if p and _SPACE not in p[1:] and not any(65 <= c <= 90 for c in p):
            seen[p] = max(s, seen.get(p, -math.inf))
    known = {s for s in seen.values() if s > -math.inf}
    ranks = all(float(s).is_integer() for s in known)
    for c in range(256):
        seen.setdefault(bytes([c]), -math.inf)
    pieces = sorted(seen, key=lambda p: (-seen[p], p))
    top = max(known, default=0.0)
    weight = np.array([seen[p] for p in pieces])
    weight = np.where(weight > -math.inf, weight, min(known, default=0.0))
    # fixed value: the shift of Zipf's law for words, 2.7
    prior = 1 / (top - weight + 2.7) if ranks else np.exp(weight - top)
    prior = np.append((1 - stop) * prior / prior.sum(), stop)
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heads: dict[int, np.ndarray] = {}
    for size in sorted({len(p) for p in pieces}):
        at = np.array([i for i, p in enumerate(pieces) if len(p) == size])
        h = _hash(np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(-1, size))
        order = np.argsort(h)
        tables[size] = (h[order], at[order])
        heads[size] = np.zeros(1 << 16, bool)
        heads[size][h >> np.uint64(48)] = True
    starts = np.array([p.startswith(_SPACE) for p in pieces] + [False])
    return Vocabulary(pieces, prior, tables, heads, starts)


def load_vocabulary(path: str) -> Vocabulary:
    """The pieces and scores of a sentencepiece model file, byte pieces included."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scored = []
    for i in range(sp.vocab_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i)
        scored.append((bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.encode(), -math.inf if sp.is_byte(i) else sp.get_score(i)))
    return make_vocabulary(scored)


def arcs(v: Vocabulary, text: np.ndarray, opens: bool = True) -> dict[int, np.ndarray]:
    """Piece ids (-1: none) by length and start, for each row of a byte matrix; ``opens`` says that the rows start a word."""
    found: dict[int, np.ndarray] = {}
    text = text.astype(np.uint64)
    h = np.zeros_like(text)
    with np.errstate(over="ignore"):
        for size in range(1, min(text.shape[1], max(v.tables)) + 1):
            h = (h[:, : text.shape[1] - size + 1] + text[:, size - 1 :] + np.uint64(1)) * _MUL
            if size not in v.tables:
                continue
            keys, at = v.tables[size]
            row, col = np.nonzero(v.heads[size][h >> np.uint64(48)])
            key = h[row, col]
            pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            piece = at[pos]
            hit = (keys[pos] == key) & ~(v.starts[piece] & ((col > 0) | (not opens)))
            if hit.any():
                found[size] = np.full(h.shape, -1)
                found[size][row[hit], col[hit]] = piece[hit]
    return found


class Lattice:
    """All segmentations of ``n`` words of one length, as piece ids by (length, start)."""

    def __init__(self, v: Vocabulary, words: list[bytes]):
        self.length = len(words[0]) + len(_SPACE)
        self.ids = arcs(v, np.frombuffer(b"".join(_SPACE + w for w in words), np.uint8).reshape(len(words), self.length))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """(words, length + 1): log of the summed weights of all ways to spell each prefix. ``logp`` ends in -inf."""
        n = len(next(iter(self.ids.values())))
        a = np.full((n, self.length + 1), -np.inf)
        a[:, 0] = 0
        for j in range(1, self.length + 1):
            ways = [a[:, j - s] + logp[ids[:, j - s]] for s, ids in self.ids.items() if s <= j]
            a[:, j] = np.logaddexp.reduce(ways, axis=0) if len(ways) > 1 else ways[0]
        return a

    def expected(self, logp: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        """Add to ``out`` each piece's expected uses over the words' segmentations, times ``counts``."""
        a = self.forward(logp)
        b = np.full_like(a, -np.inf)
        b[:, -1] = 0
        for i in range(self.length - 1, -1, -1):
            ways = [b[:, i + s] + logp[ids[:, i]] for s, ids in self.ids.items() if i + s <= self.length]
            b[:, i] = np.logaddexp.reduce(ways, axis=0) if len(ways) > 1 else ways[0]
        total = a[:, -1:]
        for s, ids in self.ids.items():
            hit = ids >= 0
            w = np.exp(a[:, : ids.shape[1]] + logp[ids] + b[:, s:] - total) * counts[:, None]
            out += np.bincount(ids[hit], w[hit], len(out))


class LongWord:
    """The lattice of one very long word: arcs are made ``window`` starts at a time, so that only the two recursions are held whole."""

    def __init__(self, v: Vocabulary, word: bytes, window: int = 1 << 15):
        self.v, self.window, self.text = v, window, np.frombuffer(_SPACE + word, np.uint8)
        self.sizes = np.array(sorted(v.tables))

    def windows(self, logp: np.ndarray, back: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first start, ids, their weights), a row for each start and a column for each length."""
        places = range(0, len(self.text), self.window)
        for lo in reversed(places) if back else places:
            n = min(self.window, len(self.text) - lo)
            ids = np.full((n, len(self.sizes)), -1)
            for size, got in arcs(self.v, self.text[None, lo : lo + n + int(self.sizes[-1]) - 1], lo == 0).items():
                got = got[0, :n]
                ids[: len(got), np.searchsorted(self.sizes, size)] = got
            yield lo, ids, logp[ids]

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """As ``Lattice.forward``, for the one word."""
        a = np.full(len(self.text) + 1 + self.sizes[-1], -np.inf)
        a[0] = 0
        for lo, _, w in self.windows(logp):
            for i, arc in enumerate(w, lo):
                a[i + self.sizes] = np.logaddexp(a[i + self.sizes], a[i] + arc)
        return a[None, : len(self.text) + 1]

    def expected(self, logp: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        """As ``Lattice.expected``, for the one word."""
        a = self.forward(logp)[0]
        b = np.full(len(self.text) + 1 + self.sizes[-1], -np.inf)
        b[len(self.text)] = 0
        for lo, ids, w in self.windows(logp, back=True):
            for i in range(len(w) - 1, -1, -1):
                b[lo + i] = np.logaddexp.reduce(b[lo + i + self.sizes] + w[i])
            start = lo + np.arange(len(w))[:, None]
            hit = ids >= 0
            uses = np.exp(a[start] + w + b[start + self.sizes] - a[-1]) * counts[0]
            out += np.bincount(ids[hit], uses[hit], len(out))


def lattices(v: Vocabulary, words: list[bytes], cells: int = 1 << 15) -> Iterator[tuple[list[int], Lattice | LongWord]]:
    """(positions, lattice) for words grouped by length, about ``cells`` bytes at a time; longer words alone, in windows."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for size, at in by.items():
        if size + len(_SPACE) > cells:
            for i in at:
                yield [i], LongWord(v, words[i], cells)
            continue
        step = max(1, cells // (size + len(_SPACE)))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield part, Lattice(v, [words[i] for i in part])


def _log(p: np.ndarray) -> np.ndarray:
    return np.append(np.log(p[:-1]), -np.inf)  # -1, no match, then weighs nothing


def _parts(**cols) -> pa.RecordBatch:
    """Rows of ``_PART``; the columns that aren't given are null."""
    n = len(cols["n"])
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _PART], schema=_PART)


def word_counts(docs: DataFrame, keep: int = 200_000) -> DataFrame:
    """(word, train, total) over (row, id, held_out, body) rows; counts are summed in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(train.keys() | held.keys())
            out = batch(_WORD, word=words, train=[train[w] for w in words], total=[train[w] + held[w] for w in words])
            train.clear()
            held.clear()
            return out

        for held_out, body in rows_of(batches, "held_out", "body"):
            (held if held_out else train).update(words_of(body))
            if len(train) + len(held) > keep:
                yield flush()
        if train or held:
            yield flush()

    got = docs.select("held_out", "body").mapInArrow(run, "word binary, train long, total long")
    return got.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def fit(spark: SparkSession, words: DataFrame, ends: int, vocabulary: Vocabulary, rounds: int = 2, strength: float = 1000.0) -> np.ndarray:
    """Piece probabilities by EM over all training words with their counts, and ``ends`` texts' ends; the vocabulary's own count as ``strength`` uses.

    Each task adds up expected uses; one number for each piece reaches the driver.
    """
    p = vocabulary.prior
    given = spark.sparkContext.broadcast(vocabulary)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], p: np.ndarray = p) -> Iterator[pa.RecordBatch]:
            v, logp, total = given.value, _log(p), np.zeros(len(p))
            for b in batches:
                counts = b.column("train").to_numpy().astype(float)
                for at, lat in lattices(v, b.column("word").to_pylist()):
                    lat.expected(logp, counts[at], total)
                total[v.stop] += counts.sum()
            seen = np.flatnonzero(total)
            yield batch(_PIECE, piece=seen, n=total[seen])

        uses = vocabulary.prior * strength
        uses[vocabulary.stop] += ends
        for r in words.where("train > 0").select("word", "train").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toLocalIterator():
            uses[r["piece"]] += r["n"]
        p = uses / uses.sum()
    given.unpersist()
    return p


def score_words(spark: SparkSession, words: DataFrame, vocabulary: Vocabulary, p: np.ndarray) -> DataFrame:
    """``words`` with log10 of each word's marginal probability: own, by the vocabulary's weights, and lattice, by ``p``."""
    given = spark.sparkContext.broadcast((vocabulary, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, learnt = given.value
        for b in batches:
            out = np.zeros((2, b.num_rows))
            for at, lat in lattices(v, b.column("word").to_pylist()):
                for k, weights in enumerate((v.prior, learnt)):
                    out[k, at] = (lat.forward(_log(weights))[:, -1] + math.log(weights[v.stop])) / math.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[0]), pa.array(out[1])], schema=_LAT)

    return words.select("word", "train", "total").mapInArrow(run, "word binary, train long, total long, own double, lattice double")


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words of the highest totals, ``most`` at most: cut between eighths of powers of two, so that no task sorts them."""
    step = F.floor(F.log2("total") * 8)
    sizes = {r["step"]: r["n"] for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}  # some 500 steps at most
    cut, n = math.inf, 0
    for k in sorted(sizes, reverse=True):
        n += sizes[k]
        if n > most:
            break
        cut = k
    return words.where(step >= cut) if cut < math.inf else words.limit(0)


def score_documents(
    spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, held_out: Column, head: int = 200_000, head_bytes: int = 64, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Score whole texts with a model learnt from the rows where ``held_out`` is not true.

    Returns one row for each input row: id, held_out, n_tokens (words and one
    end), n_known (tokens seen in training), train_tokens, base_score (add-half
    word frequencies, log10) and score (log10 of the lattice model's marginal
    probability) and own_score (the same by the vocabulary's own weights). The
    most frequent words of at most ``head_bytes`` bytes, ``head`` of them at most, so
    a bounded table, are broadcast and summed in place; others are joined by a shuffle.
    Null and empty texts hold the end alone. Without training rows the vocabulary's
    own weights are the model; an empty table gives no rows.
    """
    scratch = Scratch(spark, "lm")
    # held_out may be null where the id is: those rows train
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("body"))
    counts = scratch.table(word_counts(rows), "counts")
    n_ends = rows.where(~F.col("held_out")).count()
    seen = counts.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count_if(F.col("train") > 0).alias("v")).first()
    n, v = seen["n"] + n_ends, seen["v"] + (n_ends > 0)
    p = fit(spark, counts, n_ends, vocabulary, rounds)
    words = scratch.table(score_words(spark, counts, vocabulary, p), "words")
    scratch.drop(counts)
    bottom = math.log10(n + 0.5 * (v + 1))
    top = frequent(words.where(F.octet_length("word") <= head_bytes), head).toArrow()
    base_of = np.log10(np.array(top["train"], float) + 0.5) - bottom
    known = spark.sparkContext.broadcast((top["word"].to_pylist(), np.array(top["train"]) > 0, base_of, np.array(top["own"], float), np.array(top["lattice"], float)))
    end = (int(n_ends > 0), math.log10(n_ends + 0.5) - bottom, math.log10(vocabulary.prior[vocabulary.stop]), math.log10(p[vocabulary.stop]))
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "head" not in cache:
            names, *values = known.value
            cache["head"], cache["values"] = {w: i for i, w in enumerate(names)}, values
        get = cache["head"].get
        texts: list[tuple] = []
        words: list[bytes] = []
        uses: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            row, i, held, size = zip(*texts, strict=True)
            n, at = np.array(uses, np.int64), np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            text, hit = np.repeat(np.arange(len(size)), size), at >= 0
            of, where, times = text[hit], at[hit], n[hit]
            k, b, o, s = (e + np.bincount(of, times * x[where], len(size)) for e, x in zip(end, cache["values"], strict=True))
            tokens = 1 + np.bincount(text, n, len(size))
            yield _parts(row=row, id=i, held_out=held, n=tokens.astype(np.int64), known=k.astype(np.int64), base=b, own=o, score=s)
            rare = np.flatnonzero(~hit)
            if len(rare):
                yield _parts(row=np.array(row)[text[rare]], word=[words[j] for j in rare.tolist()], n=n[rare])
            texts.clear()
            words.clear()
            uses.clear()

        for row, i, held, body in rows_of(batches, "row", "id", "held_out", "body"):
            found = Counter(words_of(body))
            texts.append((row, i, held, len(found)))
            words.extend(found)
            uses.extend(found.values())
            if len(words) > 100_000 or len(texts) > 20_000:
                yield from flush()
        if texts:
            yield from flush()

    numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "held_out", "body")
    parts = scratch.table(numbered.mapInArrow(run, "row long, id long, held_out boolean, word binary, n long, known long, base double, own double, score double"), "parts")
    rare = parts.where("word is not null").select("row", "word", "n").join(words.select("word", "train", "own", "lattice"), "word")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("n") * (F.col("train") > 0).cast("long")).alias("known_rare"),
        F.sum(F.col("n") * (F.log10(F.col("train") + 0.5) - bottom)).alias("base_rare"),
        F.sum(F.col("n") * F.col("own")).alias("own_rare"),
        F.sum(F.col("n") * F.col("lattice")).alias("score_rare"),
    )
    zero = F.lit(0)
    return parts.where("word is null").join(rare, "row", "left").select(
        "id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("known_rare", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("score_rare", zero)).alias("score"),
        (F.col("own") + F.coalesce("own_rare", zero)).alias("own_score"),
    )
