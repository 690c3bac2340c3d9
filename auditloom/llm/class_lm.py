"""Perplexity under Brown's class-based bigram model.

The probability of a word is that of its class after the class before, times that of the word in its
class. Exchange clustering assigns words to classes: in every round all training texts are scanned for
the classes around each word, and words move to the class that raises the likelihood most. Frequent
words move each by itself, all others in groups by their ending, so every word has a class that a task
can tell without a lookup of the vocabulary. Word counts cover all training texts; the most frequent
words (a bounded list) are held by every task, the counts of the others are joined by a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import utf8
from auditloom.operators.persisting import materialize

CLASSES = 32
#: Words that move alone and groups that rarer words move in; words whose counts every task holds.
MOVED = 1 << 13
GROUPS = 1 << 10
HELD = 1 << 17
ROUNDS = 7
SMOOTHING = 0.1
#: Distinct words that a task counts before it hands its counts on.
MEMORY = 500_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z and ASCII white space only


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``texts`` (text); the null word counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = Counter(), 0
        for batch in batches:
            for text in utf8(batch.column("text")):
                seen.update(words_of(text))
            rows += batch.num_rows
            if len(seen) > MEMORY:
                yield from _counted(seen)
                seen = Counter()
        yield from _counted(seen)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([rows], pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> Iterator[pa.RecordBatch]:
    words, counts = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
    for i in range(0, len(words), 50_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(words[i : i + 50_000], pa.binary()).cast(pa.string()), pa.array(counts[i : i + 50_000])], ["word", "n"]
        )


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words of the highest counts, as many whole count ranges as ``most`` words can hold."""
    scale = F.floor(F.log2("n") * 16).cast("int")
    known = counts.filter(F.col("word").isNotNull()).withColumn("scale", scale)
    least, held = None, 0
    for scale, n in sorted(known.groupBy("scale").count().collect(), reverse=True):  # one row per range
        if held + n > most:
            break
        least, held = scale, held + n
    if least is None:
        return []
    rows = known.filter(F.col("scale") >= least).select("word", "n").toPandas()
    found = sorted(zip(rows["n"].tolist(), rows["word"].tolist(), strict=True), key=lambda r: (-r[0], r[1]))
    return [(word.encode(), n) for n, word in found]


class Units(dict):
    """Unit of a word in clustering: its own for the most frequent, else the group of its ending."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__({w: i for i, w in enumerate(words)})
        self.n = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.n + zlib.crc32(word[-3:]) % GROUPS

    @property
    def end(self) -> int:
        """The unit of the end of a text, which also stands before its first word."""
        return self.n + GROUPS


def sequences(texts: DataFrame, units: Units) -> DataFrame:
    """(units): every text as 16-bit units, between two ends."""
    shared = texts.sparkSession.sparkContext.broadcast(units)  # at most MOVED words

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shared.value
        edge = np.array([units.end], np.uint16)
        for batch in batches:
            rows = []
            for text in utf8(batch.column("text")):
                words = words_of(text)
                rows.append(np.concatenate([edge, np.fromiter(map(units.__getitem__, words), np.uint16, len(words)), edge]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["units"])

    return texts.select("text").mapInArrow(read, "units binary")


def neighbours(scanned: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each unit follows, and is followed by, each class: two tables of units x classes."""
    shared = scanned.sparkSession.sparkContext.broadcast(classes)
    n = len(classes)
    names = [f"{side}{c}" for side in "lr" for c in range(CLASSES)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(np.int64)
        left, right = np.zeros(n * CLASSES, np.int64), np.zeros(n * CLASSES, np.int64)
        for batch in batches:
            rows = batch.column("units").to_pylist()
            for i in range(0, len(rows), 500):
                part = rows[i : i + 500]
                units = np.frombuffer(b"".join(part), np.uint16).astype(np.int64)
                lasts = np.cumsum([len(r) // 2 for r in part]) - 1
                inside = np.ones(len(units), dtype=bool)
                inside[lasts] = False
                before, after = units[inside], units[1:][inside[:-1]]
                left += np.bincount(after * CLASSES + of[before], minlength=n * CLASSES)
                right += np.bincount(before * CLASSES + of[after], minlength=n * CLASSES)
        table = np.concatenate([left.reshape(n, CLASSES), right.reshape(n, CLASSES)], axis=1)
        some = np.flatnonzero(table.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), *[pa.array(table[some, k]) for k in range(2 * CLASSES)]], ["unit", *names]
            )

    found = scanned.mapInArrow(scan, "unit int, " + ", ".join(f"{x} long" for x in names))
    # At most (MOVED + GROUPS + 1) * 2 * CLASSES numbers, however large the corpus.
    rows = found.groupBy("unit").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
    tables = np.zeros((n, 2 * CLASSES), np.float64)
    tables[rows["unit"].to_numpy(np.int64)] = rows[names].to_numpy(np.float64)
    return tables[:, :CLASSES], tables[:, CLASSES:]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the classes, but for a part that no move changes."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum())


def best_classes(classes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every unit the class that would raise the likelihood most, and by how much; others stay."""
    pairs = np.zeros((CLASSES, CLASSES))
    np.add.at(pairs, classes, right)
    after, before = pairs.sum(1), pairs.sum(0)
    rows = np.arange(len(classes))
    gain = np.empty((len(classes), CLASSES))
    for i in range(0, len(classes), 1024):
        r, l = right[i : i + 1024], left[i : i + 1024]
        own = classes[i : i + 1024]
        value = (_xlogx(pairs[None] + r[:, None, :]) - _xlogx(pairs)[None]).sum(2)
        value += (_xlogx(pairs.T[None] + l[:, None, :]) - _xlogx(pairs.T)[None]).sum(2)
        value -= _xlogx(after + r.sum(1)[:, None]) - _xlogx(after) + _xlogx(before + l.sum(1)[:, None]) - _xlogx(before)
        stay = (_xlogx(pairs[own]) - _xlogx(np.maximum(pairs[own] - r, 0))).sum(1)
        stay += (_xlogx(pairs.T[own]) - _xlogx(np.maximum(pairs.T[own] - l, 0))).sum(1)
        stay -= _xlogx(after[own]) - _xlogx(np.maximum(after[own] - r.sum(1), 0)) + _xlogx(before[own]) - _xlogx(np.maximum(before[own] - l.sum(1), 0))
        value[np.arange(len(own)), own] = stay
        gain[i : i + 1024] = value - stay[:, None]
    gain[:, CLASSES - 1] = -np.inf  # the class of the end alone
    best = gain.argmax(1)
    return best, gain[rows, best]


def cluster(scanned: DataFrame, n_units: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of every unit and counts of class pairs, by exchange; the best of all rounds."""
    classes = np.minimum(np.arange(n_units), CLASSES - 2).astype(np.int32)
    classes[-1] = CLASSES - 1
    best: tuple | None = None
    for turn in range(rounds + 1):
        left, right = neighbours(scanned, classes)
        pairs = np.zeros((CLASSES, CLASSES))
        np.add.at(pairs, classes, right)
        score = likelihood(pairs)
        if best is None or score > best[0]:
            best = score, classes.copy(), pairs
        if turn == rounds:
            break
        wanted, gain = best_classes(classes, left, right)
        # At first all move; later one half at a time, or words that attract each other swap for ever.
        moves = gain > 1e-9
        moves[-1] = False
        if turn:
            moves &= (np.arange(n_units) + turn) % 2 == 0
        if not moves.any() and turn > 1:
            break
        classes = np.where(moves, wanted, classes).astype(np.int32)
    return best[1], best[2]


@dataclass
class Model:
    """What a task needs to score a text, but for the counts of the words that aren't held."""

    units: Units
    held: dict[bytes, int]  # place of a word in counts
    counts: np.ndarray
    classes: np.ndarray
    transitions: np.ndarray  # log10 P(class | class before)
    masses: np.ndarray  # log10 of the smoothed words of a class; 0 for the class of the end
    n_texts: int
    train_tokens: int
    base_mass: float


def learn(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all rows of ``texts`` (text), and the counts (word, n) of all their words."""
    counts = materialize(count_words(texts), "word-counts")
    known = F.col("word").isNotNull()
    total, distinct, n_texts = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0))
    ).first()
    held = most_frequent(counts, HELD)
    units = Units([word for word, _ in held[:MOVED]])
    scanned = materialize(sequences(texts, units), "sequences")
    classes, pairs = cluster(scanned, units.end + 1)
    shared = texts.sparkSession.sparkContext.broadcast(units)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = np.zeros(shared.value.end, np.int64), np.zeros(shared.value.end, np.int64)
        for batch in batches:
            of = np.fromiter(map(shared.value.__getitem__, utf8(batch.column("word"))), np.int64, batch.num_rows)
            words += np.bincount(of, minlength=len(words))
            sums += np.bincount(of, weights=batch.column("n").to_numpy(), minlength=len(words)).astype(np.int64)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some]), pa.array(sums[some])], ["unit", "words", "n"])

    rows = counts.filter(known).mapInArrow(grouped, "unit long, words long, n long").groupBy("unit").agg(F.sum("words").alias("words"), F.sum("n").alias("n")).toPandas()
    mass = np.full(CLASSES, SMOOTHING)  # one unknown word in every class
    np.add.at(mass, classes[rows["unit"].to_numpy(np.int64)], rows["n"].to_numpy(np.float64) + SMOOTHING * rows["words"].to_numpy(np.float64))
    masses = np.log10(mass)
    masses[CLASSES - 1] = 0.0
    return Model(
        units, {word: i for i, (word, _) in enumerate(held)}, np.array([n for _, n in held], np.float64), classes,
        np.log10(smoothed_transitions(pairs)), masses, int(n_texts), int(total), float(np.log10(total + SMOOTHING * (distinct + 1))),
    ), counts


def smoothed_transitions(pairs: np.ndarray) -> np.ndarray:
    """P(class | class before), each row backed off to the classes' shares by Witten and Bell's rule."""
    share = (pairs.sum(0) + SMOOTHING) / (pairs.sum() + SMOOTHING * CLASSES)
    kinds = np.maximum((pairs > 0).sum(1), 1)[:, None]
    return (pairs + kinds * share) / (pairs.sum(1)[:, None] + kinds)


def score(docs: DataFrame, model: Model, counts: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    ``docs`` has doc_id and text. A null or empty text is its end alone. Scores are log10 probabilities;
    words that training never met have count 0 and share the unknown word of their class. Repeated rows
    are scored each; other columns are ignored. Without training texts all words are unknown.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most HELD words

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs = np.log10(np.append(m.counts, 1.0) + SMOOTHING)
        logs[-1] = 0.0  # of words that aren't held: joined later
        end = m.classes[m.units.end]
        end_log = float(np.log10(m.n_texts + SMOOTHING))
        for batch in batches:
            tails, at, known, own, chain, tokens = [], [], [], [], [], []
            for row, text in enumerate(utf8(batch.column("text"))):
                words = words_of(text)
                n = len(words)
                place = np.fromiter((m.held.get(w, -1) for w in words), np.int64, n)
                of = m.classes[np.fromiter(map(m.units.__getitem__, words), np.int64, n)]
                path = np.concatenate([[end], of, [end]])
                tokens.append(n + 1)
                known.append(int((place >= 0).sum()) + (m.n_texts > 0))
                own.append(float(logs[place].sum()))
                chain.append(float(m.transitions[path[:-1], path[1:]].sum() - m.masses[of].sum()))
                rare = Counter(words[i] for i in np.flatnonzero(place < 0).tolist())
                tails.extend(rare.items())
                at.extend([row] * len(rare))
            n, k = batch.num_rows, len(tails)
            rid = batch.column("__row")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([rid, rid.take(pa.array(at, pa.int64()))]),
                    pa.concat_arrays([batch.column("doc_id"), pa.nulls(k, batch.column("doc_id").type)]),
                    pa.concat_arrays([batch.column("held_out"), pa.nulls(k, pa.bool_())]),
                    pa.array(tokens + [None] * k, pa.int64()), pa.array(known + [None] * k, pa.int64()),
                    pa.array([x + end_log - t * m.base_mass for x, t in zip(own, tokens, strict=True)] + [None] * k, pa.float64()),
                    pa.array([x + y for x, y in zip(own, chain, strict=True)] + [None] * k, pa.float64()),
                    pa.array([None] * n + [w for w, _ in tails], pa.binary()).cast(pa.string()),
                    pa.array([None] * n + [c for _, c in tails], pa.int64()),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", held_out.alias("held_out"), "text", F.monotonically_increasing_id().alias("__row"))
    partial = materialize(
        numbered.mapInArrow(
            read,
            f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, word string, times long",
        ),
        "partial-scores",
    )
    rare = partial.filter(F.col("word").isNotNull()).select("row", "word", "times").join(counts.filter(F.col("word").isNotNull()), "word", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING))
    sums = rare.groupBy("row").agg(F.sum(log).alias("log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    whole = partial.filter(F.col("word").isNull()).drop("word", "times").join(sums.hint("merge"), "row", "left")
    rest = F.coalesce("log", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), (F.col("base_score") + rest).alias("base_score"),
        (F.col("score") + rest).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
