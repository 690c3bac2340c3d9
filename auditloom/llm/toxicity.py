"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams, a text the mean of its words, and a
linear softmax over that mean gives the score. Vectors and softmax are trained together in numpy on
a bounded sample of labelled rows. A misspelt or inflected word that training never met shares most
of its n-grams with one that it did. As everything up to the softmax is linear, a word adds one
number to a text's score, which a task works out once while it remembers the word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows of each class that training reads; those with the smallest hash of the text.
ROWS_PER_CLASS = {0: 3000, 1: 1500}
#: n-gram buckets, size of a vector, n-gram lengths.
BUCKETS = 1 << 18
DIMENSIONS = 4
NGRAMS = (3, 4, 5, 6)
EPOCHS = 120
RATE = 0.3
DECAY = 0.02
THRESHOLD = 0.3
MEMORY = 500_000
STRIP = ".,;:!?\"'()[]{}<>|*#$%&"


@dataclass
class Model:
    """Vector sums folded into one number per n-gram bucket, and the bias."""

    weights: np.ndarray
    bias: float


def clean_word(word: str) -> str:
    return word.lower().strip(STRIP)


def ngrams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every word with its ends marked, and of the whole word, word by word;
    and how many each word has."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(marked)), lengths)
    at = np.arange(len(codes))
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in marked), dtype=np.uint64, count=len(marked))
    owners, found = [np.arange(len(marked))], [whole]
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            rolling[: max(0, len(codes) - n + 1)] *= np.uint64(0x9E3779B97F4A7C15)
            rolling[: max(0, len(codes) - n + 1)] += codes[n - 1 :] + np.uint64(n)
            if n in NGRAMS:
                inside = at + n <= ends
                owners.append(owner[inside])
                found.append((rolling[inside] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20))
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return (found[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owners, minlength=len(marked))


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: dict = ROWS_PER_CLASS) -> DataFrame:
    """(h, doc_id, toxic, text) of at most ``per_class`` labelled ids of each class, one row for each.

    Of an id that ``docs`` repeats with other texts, the text with the smallest hash counts.
    """
    known = labels.filter(allowed & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    # Two bounded lists of ids: a broadcast of a known size, so no text is shuffled.
    chosen = [known.filter(F.col("toxic") == y).distinct().orderBy(order, "doc_id").limit(per_class[y]) for y in (0, 1)]
    met = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    return met.groupBy("doc_id", "toxic").agg(first).select("one.h", "doc_id", "toxic", "one.text")


def _ragged(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((x for one in lists for x in one), dtype=np.int64, count=int(lengths.sum()))
    return flat, lengths


class _Means:
    """Means of rows over ragged groups, and the way back for gradients."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, n: int) -> None:
        self.flat, self.lengths, self.n = flat, lengths, n
        self.starts = np.r_[0, np.cumsum(lengths)[:-1]]
        self.scale = (1.0 / lengths).astype(np.float32)[:, None]
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(flat, kind="stable")
        self.back = self.owner[order]
        self.present, self.back_starts = np.unique(flat[order], return_index=True)

    def of(self, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(rows[self.flat], self.starts, axis=0) * self.scale

    def gradient(self, groups: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, groups.shape[1]), dtype=np.float32)
        out[self.present] = np.add.reduceat((groups * self.scale)[self.back], self.back_starts, axis=0)
        return out


def train(texts: Sequence[str], toxic: Sequence[int], seed: int = 7) -> Model:
    """Joint training by Adam over all rows at once, with a rate that falls to nothing.

    Every n-gram of the texts has a vector; ``DECAY`` holds those of rare ones near zero. Without both classes the score is the
    share of class 1 (0 without rows).
    """
    y = np.asarray(toxic, dtype=np.float32)
    share = float(y.mean()) if len(y) else 0.0
    bags = [list(map(clean_word, text.split())) for text in texts]
    used = [i for i, bag in enumerate(bags) if bag]
    if not used or share in (0.0, 1.0):
        odds = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log(odds / (1 - odds))))
    y = y[used]
    numbers: dict[str, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in bags[i]] for i in used]
    flat, lengths = ngrams(list(numbers))
    met = np.zeros(BUCKETS, dtype=bool)
    met[flat] = True
    of_word = _Means(flat, lengths, BUCKETS)
    of_text = _Means(*_ragged(words), len(numbers))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32) * met[:, None]
    softmax = rng.normal(0, 1, (DIMENSIONS, 1)).astype(np.float32)
    bias = np.array([np.log(y.mean() / (1 - y.mean()))], dtype=np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    for step in range(1, EPOCHS + 1):
        mean = of_text.of(of_word.of(vectors))
        p = 1 / (1 + np.exp(-np.clip(mean @ softmax + bias, -30, 30)))
        error = (p - y[:, None]) / len(y)
        to_vectors = of_word.gradient(of_text.gradient(error @ softmax.T)) * met[:, None] + DECAY * vectors / len(y)
        gradients = (to_vectors, mean.T @ error + DECAY * softmax / len(y), error.sum(0))
        for value, slope, (m, v) in zip((vectors, softmax, bias), gradients, state, strict=True):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            value -= RATE * (1 - (step - 1) / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return Model((vectors @ softmax)[:, 0], float(bias[0]))


class WordScores:
    """What words add to the sum of their text, worked out once while they are remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def of(self, texts: Sequence[str]) -> np.ndarray:
        """Scores of texts."""
        split = [text.split() for text in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        self.learn({w for words in split for w in words} - self.known.keys())
        sums = np.array([sum(map(self.known.__getitem__, words)) for words in split], dtype=np.float64)
        logits = sums / np.maximum(1, [len(words) for words in split]) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def learn(self, words: set[str]) -> None:
        new = list(words)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            flat, lengths = ngrams([clean_word(w) for w in part])
            sums = np.add.reduceat(self.model.weights[flat], np.r_[0, np.cumsum(lengths)[:-1]])
            self.known.update(zip(part, (sums / lengths).tolist(), strict=True))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row (doc_id, text); a null, empty or wordless text gets the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(shared.value)
        for batch in batches:
            texts = [text.as_py() or "" for text in batch.column("text")]
            values = np.concatenate([scores.of(texts[i : i + 500]) for i in range(0, len(texts), 500)] or [[]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def learn(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """Model of the labelled rows that ``allowed`` (a condition on labels) admits.

    The sample holds more of the rarer class than the rows do; the bias is put right by the counts of
    both classes over all admitted rows. The rows are put in order first, as sums of floats depend on it: the model
    is the same however the tables are partitioned.
    """
    rows = training_rows(docs, labels, allowed).toPandas().sort_values(["h", "doc_id", "toxic"])
    model = train(rows["text"].fillna("").tolist(), rows["toxic"].tolist())
    all_rows = labels.filter(allowed).agg(*[F.count_if(F.col("toxic") == y) for y in (0, 1)]).first()
    drawn = [int((rows["toxic"] == y).sum()) for y in (0, 1)]
    if min(*drawn, *all_rows) > 0:
        model.bias += float(np.log(all_rows[1] / all_rows[0]) - np.log(drawn[1] / drawn[0]))
    return model
