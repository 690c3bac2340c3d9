"""Spelling variants: words that differ by one code point, found through pairs of trie nodes.

The words are sorted once as they are and once reversed, which lays out a forward and a reversed trie:
a node is numbered by the first word that reaches it. A word leaves a pair (prefix node, suffix node)
for every position that is skipped and for every place where a code point could be inserted. Words
that leave the same pair by skipping differ by one replaced code point; one that leaves it by inserting
lacks the code point that the others skip. Nodes that one word alone reaches leave no pair.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import utf8
from auditloom.operators.lookup import lookup
from auditloom.operators.persisting import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NOT_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
MIN_LENGTH = 5
MIN_COUNT = 3
#: A form is at least so many times as frequent.
RATIO = 2
#: One run in so many loses a code point (a rule on the crc of id and run).
TYPO = 97
#: Bytes of words that a task remembers, characters of text that are split at a time, occurrences counted at a time.
MEMORY = 48 << 20
SLICE = 1 << 20
COUNTED = 1 << 20
#: Longest run, in bytes, whose crc comes from a table.
TABLED = 64
ROWS = 20_000
#: How a word leaves a pair: by an insertion, or by skipping a code point that is not, or is, the first of a row of equal ones.
INSERTED, SKIPPED, SKIPPED_FIRST = 0, 1, 2


class _Words(dict):
    """Numbers of words, with the crc, size in bytes and count of each."""

    def __init__(self) -> None:
        self.held, self.waiting, self.n_waiting = 0, [], 0
        self.crc, self.size, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        if number >= len(self.crc):
            self.crc, self.size, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.crc, self.size, self.n))
        data = word.encode()
        self.crc[number], self.size[number] = zlib.crc32(data), len(data)
        self.held += 100 + 2 * len(data)
        return number

    def add(self, numbers: np.ndarray) -> None:
        self.waiting.append(numbers)
        self.n_waiting += len(numbers)
        if self.n_waiting > COUNTED:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            self.n += np.bincount(np.concatenate(self.waiting), minlength=len(self.n))
        self.waiting, self.n_waiting = [], 0

    def flush(self, min_length: int) -> pa.RecordBatch:
        self.settle()
        held = [(w, int(self.n[i])) for w, i in self.items() if len(w) >= min_length and self.n[i]]
        self.clear()
        self.held, self.n = 0, np.zeros_like(self.n)
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], ["word", "n"])


def _slices(text: str) -> Iterator[str]:
    """Parts of a text that cut no run."""
    at = 0
    while at < len(text):
        gap = NOT_LETTER.search(text, at + SLICE)
        upto = gap.start() if gap else len(text)
        yield text[at:upto] if at or gap else text
        at = upto


_ZEROS = [zlib.crc32(bytes(n)) for n in range(TABLED + 1)]


def _crcs(start: int, runs: list[str], numbers: np.ndarray, words: _Words) -> np.ndarray:
    """crc32 of what has the crc ``start``, followed by each run: a crc is linear in what precedes."""
    sizes = words.size[numbers]
    longest = min(TABLED, int(sizes.max()))
    shift = np.array([zlib.crc32(bytes(n), start) ^ _ZEROS[n] for n in range(longest + 1)], np.uint32)
    out = shift[np.minimum(sizes, longest)] ^ words.crc[numbers]
    for i in np.flatnonzero(sizes > TABLED).tolist():
        out[i] = zlib.crc32(runs[i].encode(), start)
    return out


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) over all texts; n is combined per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for part in _slices(text.lower().decode()):  # of bytes: A-Z only
                    runs = RUN.findall(part)
                    if not runs:
                        continue
                    if words.held > MEMORY:
                        yield words.flush(min_length)
                    numbers = np.fromiter(map(words.__getitem__, runs), np.int64, len(runs))
                    crcs = _crcs(start, runs, numbers, words)
                    changed = crcs % TYPO == 0
                    for i in np.flatnonzero(changed).tolist():
                        at = int(crcs[i]) % len(runs[i])
                        numbers[i] = words[runs[i][:at] + runs[i][at + 1 :]]
                    words.add(numbers)
        yield words.flush(min_length)

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def _numbered(words: DataFrame, key: Column, nodes: str) -> tuple[DataFrame, np.ndarray]:
    """``words`` with the trie nodes of the prefixes of ``key``, and which nodes of a partition are nodes of an earlier one.

    ``nodes`` has the numbers of the prefixes by length, as far as another word shares them; ``node_of`` is the
    number of the whole key, which grows with the key in code-point order. Sorted keys lay the trie out: a
    prefix gets its number where it is first met in its partition. The last key of a partition may share
    prefixes with the first one of the next: these are pairs (number, number it stands for). Two rows per
    partition reach the driver for them.
    """
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in words.schema.fields)
    names = words.columns
    ranged = words.withColumn("__key", key).repartitionByRange("__key").sortWithinPartitions("__key")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base, above, path, last = None, 0, 0, [], ""  # the row that waits for the next key, what it shares with the one before

        def out(rows: pa.Table, depths: list[list[int]], ends: list[int], edge: list[bool]) -> Iterator[pa.RecordBatch]:
            rows = rows.append_column(nodes, pa.array(depths, pa.list_(pa.int64()))).append_column("node_of", pa.array(ends, pa.int64()))
            yield from rows.append_column("edge", pa.array(edge, pa.bool_())).combine_chunks().to_batches()

        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            keys = batch.column("__key").to_pylist()
            rows = pa.Table.from_batches([batch]).select([*names, "__key", "__part"])
            depths, ends, edge = [], [], []
            start = base == 0
            if start:
                base = batch.column("__part")[0].as_py() << 40
                first_row = True
            for k in keys:
                if start:
                    below, path = -1, []
                else:
                    below = _shared(last, k)
                    depths.append(path if first_row else path[: max(above, below) + 1])
                    ends.append(path[-1])
                    edge.append(first_row)
                    first_row = False
                start = False
                path = [*path[: below + 1], *range(base + below + 1, base + len(k) + 1)]
                base += len(k) + 1
                above, last = max(below, 0), k
            rows = rows if held is None else pa.concat_tables([held, rows])
            if len(depths):
                yield from out(rows.slice(0, len(depths)), depths, ends, edge)
            held = rows.slice(len(depths))
        if held is not None:
            yield from out(held, [path], [path[-1]], [True])

    schema = f"{kinds}__key string, __part int, {nodes} array<bigint>, node_of long, edge boolean"
    done = materialize(ranged.withColumn("__part", F.spark_partition_id()).mapInArrow(number, schema), f"trie-{nodes}")
    stands_for: dict[int, int] = {}
    last, path, part = None, [], None
    for row in sorted(done.filter("edge").select("__part", "__key", nodes).collect()):
        if part != row["__part"] and last is not None:
            for depth in range(_shared(last, row["__key"]) + 1):
                stands_for[row[nodes][depth]] = path[depth]
        part, last, path = row["__part"], row["__key"], [stands_for.get(x, x) for x in row[nodes]]
    pairs = np.array(sorted(stands_for.items()), np.int64).reshape(-1, 2)
    return done.drop("__key", "__part", "edge"), pairs


def _exchanged(values: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """``values`` with those in the first column of ``pairs`` replaced by the second."""
    if not len(pairs):
        return values
    at = np.minimum(np.searchsorted(pairs[:, 0], values), len(pairs) - 1)
    return np.where(pairs[at, 0] == values, pairs[at, 1], values)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and values of the ranges ``low`` to ``high`` (included), one after the other."""
    n = np.maximum(high - low + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n - low, n)


def _pairs(tries: DataFrame, forward: np.ndarray, reverse: np.ndarray) -> DataFrame:
    """(prefix, suffix, role, n, number): the node pairs that the words leave."""
    # Pairs of numbers for the seams between partitions: at most a word's length for each partition.
    seams = tries.sparkSession.sparkContext.broadcast((forward, reverse))

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, back = seams.value
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            words = batch.column("word").to_pylist()
            size = np.fromiter(map(len, words), np.int64, len(words))
            codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            starts = np.cumsum(size) - size
            first = np.r_[True, codes[1:] != codes[:-1]]
            first[starts] = True
            sides = []
            for name, seam in (("prefixes", ahead), ("suffixes", back)):
                column = batch.column(name)
                offsets = column.offsets.to_numpy().astype(np.int64)
                sides.append((_exchanged(column.flatten().to_numpy(), seam), offsets[:-1] - offsets[0], np.diff(offsets)))
            (p, p_at, p_n), (s, s_at, s_n) = sides
            columns = [[], [], [], []]
            for gap in (1, 0):  # a code point is skipped, or one is inserted
                rows, i = _spread(np.maximum(0, size - gap - s_n + 1), np.minimum(p_n - 1, size - gap))
                role = np.where(first[starts[rows] + i], SKIPPED_FIRST, SKIPPED) if gap else np.full(len(rows), INSERTED)
                for column, values in zip(columns, (p[p_at[rows] + i], s[s_at[rows] + size[rows] - gap - i], role, rows), strict=True):
                    column.append(values)
            prefix, suffix, role, rows = map(np.concatenate, columns)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix, pa.int64()), pa.array(suffix, pa.int64()), pa.array(role, pa.int8()),
                 batch.column("n").take(rows), batch.column("number").take(rows)],
                ["prefix", "suffix", "role", "n", "number"],
            )

    return tries.select("word", "n", "number", "prefixes", "suffixes").mapInArrow(
        leave, "prefix long, suffix long, role byte, n long, number long"
    )


def _near(pairs: DataFrame) -> DataFrame:
    """(number, n_near, best): the number of near words, and the most frequent as (n, -number).

    Words that leave one pair differ in one code point, so they are as many as the letters at most (90), and
    one more. They are gathered, and each of them counts the others within the row; no pair of words is a row.
    """
    members = F.collect_list(F.struct("role", "n", "number"))
    groups = pairs.groupBy("prefix", "suffix").agg(members.alias("members")).filter(F.size("members") > 1)

    def linked(x: Column, y: Column) -> Column:
        replaced = (x["role"] != INSERTED) & (y["role"] != INSERTED) & (x["number"] != y["number"])
        return replaced | (x["role"] == INSERTED) & (y["role"] == SKIPPED_FIRST) | (x["role"] == SKIPPED_FIRST) & (y["role"] == INSERTED)

    def found(x: Column) -> Column:
        near = F.filter("members", lambda y: linked(x, y))
        return F.struct(x["number"].alias("number"), F.transform(near, lambda y: F.struct(y["n"].alias("n"), (-y["number"]).alias("first"))).alias("near"))

    each = groups.select(F.explode(F.transform("members", found)).alias("of")).select("of.number", "of.near").filter(F.size("near") > 0)
    return each.groupBy("number").agg(F.sum(F.size("near")).alias("n_near"), F.max(F.array_max("near")).alias("best"))


def _roots(pointers: DataFrame) -> DataFrame:
    """(number, top) at the end of every chain of ``pointers`` (number, top): each round doubles the steps taken.

    A form is ``RATIO`` times as frequent, so chains end, after log2 of the largest count steps at most.
    """
    while True:
        onward = pointers.select(F.col("number").alias("top"), F.col("top").alias("onward"))
        moved = materialize(lookup(pointers, onward, "top", "left"), "chains")
        pointers = moved.select("number", F.coalesce("onward", "top").alias("top"))
        if moved.filter(F.col("onward").isNotNull()).isEmpty():
            return pointers


def group_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``counts`` (word, n; distinct words, without nulls).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; n_near counts them.
    The form of a word is its near word of largest n (ties: first in code-point order) if that is at least
    ``ratio`` times the word's own n, else null, as is form_n. root is the last word on the way from form to form,
    the word itself without a form. Other columns are ignored; ``ratio`` must be above 1. A group holds as many words
    as there are different code points in them, and the alphabet bounds it.
    """
    words, forward = _numbered(counts.select("word", "n"), F.col("word"), "prefixes")
    words = words.withColumnRenamed("node_of", "number")
    tries, reverse = _numbered(words, F.reverse("word"), "suffixes")
    near = _near(_pairs(tries, forward, reverse))
    enough = F.col("best.n") >= ratio * F.col("n")
    ahead = words.select("word", "n", "number").join(near, "number", "left").select(
        "word", "n", "number", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, -F.col("best.first")).alias("form_number"), F.when(enough, F.col("best.n")).alias("form_n"),
    )
    ahead = materialize(ahead, "forms")
    linked = ahead.filter(F.col("form_number").isNotNull())
    roots = _roots(linked.select("number", F.col("form_number").alias("top")))
    name = words.select("number", "word")
    forms = lookup(linked.select("number", "form_number"), name.select(F.col("number").alias("form_number"), F.col("word").alias("form")), "form_number")
    tops = lookup(roots, name.select(F.col("number").alias("top"), F.col("word").alias("root")), "top")
    return (
        ahead.join(forms.select("number", "form"), "number", "left").join(tops.select("number", "root"), "number", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``group_variants`` of the words of ``docs`` (doc_id, text).

    Runs of the letters A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased; a run loses the code point
    h % length where ``TYPO`` divides h, the crc32 of ``<doc_id>:<run>`` (a null id is empty). Words are the
    results of at least ``min_length`` code points that occur ``min_count`` times or more. Null and empty texts
    have none; repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    return group_variants(materialize(word_counts(docs, min_length, min_count), "words"))
