"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are split into words by the tokenizer's own pattern, in blocks of documents. A block turns into
the positions of its words in the list of its distinct words. The lists are dealt out by a hash of
the word, so every distinct word of the corpus is in one part and is encoded once there, and the ids
go back to the blocks, where they are joined by position. Decoding joins ids with the pieces of the
vocabulary, which is fixed and small, and reads the bytes of a whole text at once.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Characters of text in a block, unless one document has more.
BLOCK_CHARS = 10_000_000
#: Characters of text that are cut into words at a time, unless one document has more.
SPLIT_CHARS = 500_000
#: Rows of a block that are decoded at a time.
SLICE = 500
#: Fixed values of the byte-level tokenizer: its pattern, and the text it takes as one special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LETTER, NUMBER, BLANK, OTHER = range(4)
SPACE, APOSTROPHE, CONTRACTED = ord(" "), ord("'"), ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=4)
def _loaded(path: str, changed: int, size: int) -> Tokenizer:
    return Tokenizer.from_file(path)


def loaded(path: str) -> Tokenizer:
    """The tokenizer of a file, loaded once by a process that serves many tasks.

    A tokenizer that has encoded leaves the caches of its threads behind when it goes.
    """
    facts = os.stat(path)
    return _loaded(path, facts.st_mtime_ns, facts.st_size)


class EncodedWords(dict):
    """The ids of a word as bytes, encoded when it is first met.

    Words are encoded one by one: batches start threads on cores that the task doesn't have, each with a cache.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.encode = tokenizer.encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = array("I", self.encode(word, add_special_tokens=False).ids).tobytes()
        return ids


def special_tokens(path: str) -> list[str]:
    return [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every code point, by the classes of the pattern; looked up once by a process."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N"), (BLANK, "White_Space")):
        for run in regex.finditer(rf"\p{{{name}}}+", every):
            kinds[slice(*run.span())] = kind
    return kinds


def _starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which code points start a word of ``PATTERN``, in stretches of text that begin at ``bounds``.

    Words are runs of one kind, but for three things. The last of some blanks is apart, unless no text follows. A space
    goes with what follows. A run that is a lone apostrophe takes the letters of its contraction with it.
    """
    size = len(points)
    kinds = _kinds()[points]
    begins = np.zeros(size + 1, bool)
    begins[bounds] = begins[size] = True
    starts = begins.copy()
    starts[1:size] |= kinds[1:] != kinds[:-1]
    after = np.flatnonzero((kinds[:-1] == BLANK) & (kinds[1:] != BLANK) & ~begins[1:size]) + 1
    starts[after - 1] = True
    starts[after[points[after - 1] == SPACE]] = False

    at = np.flatnonzero((points == APOSTROPHE) & starts[:size] & ~begins[1:])
    for letters in CONTRACTED:
        fits = at[at + len(letters) < size]
        for i, letter in enumerate(letters, 1):
            fits = fits[(points[fits + i] == ord(letter)) & ~begins[fits + i]]
        starts[fits + 1] = False
        starts[fits + 1 + len(letters)] = True
    return starts[:size]


class Splitter:
    """Cuts texts into the words that the tokenizer encodes one by one; special tokens are words.

    A slice of texts is cut as one array of code points and becomes one Arrow array of words, so no word is a Python
    object and no text is matched against the pattern.
    """

    def __init__(self, special: Sequence[str]) -> None:
        self.special = sorted(special, key=len, reverse=True)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def __call__(self, texts: Sequence[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, one after the other, and the number of words of each text."""
        stretches, whole = [], []
        for text in texts:
            if self.apart is not None and any(map(text.__contains__, self.special)):
                parts = self.apart(text)
                whole += [len(stretches) + i for i in range(1, len(parts), 2)]
                stretches += parts
            else:
                stretches.append(text)
        joined = "".join(texts)
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        ends = np.cumsum(sizes)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = _starts(points, (ends - sizes)[sizes > 0]) if len(points) else np.zeros(0, bool)
        for i in whole:
            starts[ends[i] - sizes[i] + 1 : ends[i]] = False
        firsts = np.flatnonzero(starts)
        ends_of = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        counts = np.diff(np.searchsorted(firsts, ends_of), prepend=0)
        data = joined.encode()
        if len(data) > len(points):
            wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            firsts = (np.cumsum(wide) - wide)[firsts]
        offsets = np.append(firsts, len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(firsts), pa.py_buffer(offsets), pa.py_buffer(data)), counts


def _blocks(texts: DataFrame, special: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(block, *keep, codes): every document as the numbers of its words in its block."""

    def close(block: int, kept: list[pa.RecordBatch], words: pa.ChunkedArray, counts: np.ndarray) -> pa.RecordBatch:
        numbers = np.concatenate([np.empty(0, np.uint32), *(c.indices.to_numpy() for c in words.chunks)])
        ends = np.cumsum(counts)
        packed = [_packed(numbers[a:b]) for a, b in zip(ends - counts, ends, strict=True)]
        columns = [pa.concat_arrays([rows.column(c) for rows in kept]) for c in keep]
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * len(packed), pa.int64()), *columns, pa.array(packed, pa.binary())], ["block", *keep, "codes"]
        )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.select(*keep).schema.fields)
    return texts.select("__row", *keep, "text").mapInArrow(_reader(special, close), f"block long, {kinds}codes binary")


def _vocabularies(texts: DataFrame, special: Sequence[str], parts: int) -> DataFrame:
    """(block, part, numbers, sizes, letters): the distinct words of a block, dealt out by a hash of the word."""

    def close(block: int, kept: list[pa.RecordBatch], words: pa.ChunkedArray, counts: np.ndarray) -> pa.RecordBatch:
        distinct = words.chunk(0).dictionary if words.num_chunks else pa.array([], pa.string())
        hashes = map(zlib.crc32, distinct.cast(pa.binary()).to_pylist())
        part = np.fromiter(hashes, np.uint32, len(distinct)) % parts
        order = np.argsort(part, kind="stable")
        dealt, firsts = np.unique(part[order], return_index=True)
        runs = list(pairwise([*firsts.tolist(), len(order)]))
        sorted_words = distinct.take(pa.array(order))
        sizes = pc.utf8_length(sorted_words).to_numpy()
        letters = sorted_words.buffers()[2]
        at = np.cumsum([0, *pc.binary_length(sorted_words).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * len(dealt), pa.int64()), pa.array(dealt, pa.int32()),
                pa.array([_packed(order[a:b]) for a, b in runs], pa.binary()),
                pa.array([_packed(sizes[a:b]) for a, b in runs], pa.binary()),
                pa.array([_squeezed(letters[int(at[a]) : int(at[b])]) for a, b in runs], pa.binary()),
            ],
            ["block", "part", "numbers", "sizes", "letters"],
        )

    kinds = "block long, part int, numbers binary, sizes binary, letters binary"
    return texts.select("__row", "text").mapInArrow(_reader(special, close), kinds)


def _reader(special: Sequence[str], close: Callable) -> Callable:
    """Reads rows of (__row, text, ...) in blocks of text and yields what ``close`` makes of each.

    A block is named by the number of its first row. ``close`` takes the name, the other columns of the rows, their words
    as Arrow dictionaries, which number the words in the order in which they are first met, and how many each row has.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(special)
        kept, words, counts, chars = [], [], [], 0

        def closed() -> pa.RecordBatch:
            coded = pa.chunked_array(words, pa.string()).dictionary_encode()
            return close(kept[0].column("__row")[0].as_py(), kept, coded, np.concatenate(counts))

        def add(rows: pa.RecordBatch, texts: list[str]) -> None:
            found, n = split(texts)
            kept.append(rows)
            words.append(found)
            counts.append(n)

        for batch in batches:
            texts, batch = batch.column("text"), batch.drop_columns(["text"])
            first, some, size = 0, [], 0
            for i, text in enumerate(texts):
                text = text.as_py() or ""
                full = (kept or some) and chars + len(text) > BLOCK_CHARS
                if some and (full or size + len(text) > SPLIT_CHARS):
                    add(batch.slice(first, i - first), some)
                    first, some, size = i, [], 0
                if full:
                    yield closed()
                    kept, words, counts, chars = [], [], [], 0
                some.append(text)
                size += len(text)
                chars += len(text)
            if some:
                add(batch.slice(first), some)
        if kept:
            yield closed()

    return read


def _squeezed(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def _packed(values: np.ndarray) -> bytes:
    """The four bytes of all numbers apart, compressed: most numbers are small."""
    return _squeezed(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _words(sizes: bytes, letters: bytes) -> list[str]:
    text = zstandard.decompress(letters).decode()
    return [text[a:b] for a, b in pairwise(accumulate(_unpacked(sizes).tolist(), initial=0))]


def encode_words(vocabularies: DataFrame, path: str) -> DataFrame:
    """(block, numbers, lengths, ids); each distinct word is encoded once, in the task that has its part.

    A task takes its parts one after the other and holds the words of one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = EncodedWords(loaded(path)), None
        for batch in batches:
            lengths, ids = [], []
            for part, sizes, letters in zip(*(batch.column(c).to_pylist() for c in ("part", "sizes", "letters")), strict=True):
                if part != last:
                    known.clear()
                    last = part
                own = [known[w] for w in _words(sizes, letters)]
                lengths.append(_packed(np.fromiter(map(len, own), np.uint32, len(own)) // 4))
                ids.append(_packed(np.frombuffer(b"".join(own), np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("numbers"), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())],
                ["block", "numbers", "lengths", "ids"],
            )

    return vocabularies.repartition("part").sortWithinPartitions("part").mapInArrow(
        read, "block long, numbers binary, lengths binary, ids binary"
    )


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) - np.repeat(ends - lengths - starts, lengths)]


class _Runs:
    """Runs of numbers by their own number."""

    def __init__(self, rows: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], dtype: type) -> None:
        rows = list(rows)
        numbers, lengths, values = (np.concatenate([r[k] for r in rows] or [np.empty(0, np.uint32)]) for k in range(3))
        size = int(numbers.max()) + 1 if len(numbers) else 0
        self.values = values.astype(dtype)
        self.lengths, self.starts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.lengths[numbers] = lengths
        self.starts[numbers] = np.cumsum(lengths, dtype=np.int64) - lengths

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return _gather(self.values, self.starts[numbers], self.lengths[numbers])


def encode(
    docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), then: Callable | None = None, columns: str = ""
) -> DataFrame:
    """``keep`` columns, ids (binary, little-endian unsigned 32-bit) and n_tokens of every row of ``docs``.

    Whole texts, as the tokenizer of the file encodes them without adding special tokens; special tokens
    that a text spells out are encoded as such. A null or empty text has no ids. Repeated rows are
    encoded each. The texts are read twice in the same partitions, once for words and once for
    positions, so ``docs`` must be a table read from files; write others first.

    ``then`` goes on with the result in the same task: it takes Arrow tables of some rows and returns
    tables of the ``keep`` columns and ``columns`` (DDL).
    """
    numbered = docs.select("text", *[F.col(f"`{c}`") for c in keep]).withColumn("__row", F.monotonically_increasing_id())
    parts = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    special = special_tokens(path)
    documents = _blocks(numbered, special, keep)
    coded = encode_words(_vocabularies(numbered, special, parts), path)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        facts = (map(_unpacked, right.column(c).to_pylist()) for c in ("numbers", "lengths", "ids"))
        words, done = _Runs(zip(*facts, strict=True), np.uint32), []
        for i in range(0, left.num_rows, SLICE):
            part = left.slice(i, SLICE)
            ids = [words.of(_unpacked(codes.as_py())) for codes in part.column("codes")]
            out = part.select(keep).append_column("ids", pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()))
            out = out.append_column("n_tokens", pa.array(map(len, ids), pa.int64()))
            done.append(out if then is None else then(out))
        return pa.concat_tables(done)

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    return documents.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(join, kinds + (columns or "ids binary, n_tokens long"))


def pieces(path: str) -> dict[int, bytes]:
    """The bytes that every id of the vocabulary stands for."""
    tokenizer = Tokenizer.from_file(path)
    special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    # Byte-level vocabularies show each byte as a printable character: printable bytes as themselves,
    # the others in order from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {i: special[i] if i in special else bytes(map(byte_of.__getitem__, piece)) for piece, i in tokenizer.get_vocab().items()}


def decoder(spark: SparkSession, path: str) -> Callable[[pa.ChunkedArray], pa.Array]:
    """A function from ids (binary) to texts that joins every id with its piece.

    The vocabulary is a fixed table of the tokenizer file; it is sent to the tasks, ids are not.
    """
    table = sorted(pieces(path).items())
    numbers, lengths = np.array([i for i, _ in table], np.uint32), np.array([len(b) for _, b in table], np.uint32)
    shared = spark.sparkContext.broadcast((numbers, lengths, np.frombuffer(b"".join(b for _, b in table), np.uint8)))

    def texts(column: pa.ChunkedArray) -> pa.Array:
        bytes_of = _Runs([shared.value], np.uint8)
        size = len(bytes_of.lengths)
        out = []
        for ids in column:
            ids = np.frombuffer(ids.as_py() or b"", "<u4")
            out.append(bytes_of.of(ids[ids < size]).tobytes().decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return texts


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with text decoded from ids (binary as in encode), special tokens included.

    Bytes that aren't UTF-8 become U+FFFD. Null ids give an empty text; ids outside the vocabulary give
    nothing. An own column text is replaced, any others are kept.
    """
    names = [c for c in rows.columns if c != "text"]
    texts = decoder(rows.sparkSession, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(i, SLICE) for batch in batches for i in range(0, batch.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], texts(batch.column("ids"))], [*names, "text"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*names).schema.fields)
    return rows.select(*names).mapInArrow(read, f"{kinds}text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded, decoded and digested block by block."""
    texts = decoder(docs.sparkSession, path)

    def digests(table: pa.Table) -> pa.Table:
        ids, decoded = table.column("ids"), texts(table.column("ids"))
        return table.select(["doc_id", "n_tokens"]).append_column(
            "ids_sha256", pa.array([sha256(x.as_py()).hexdigest() for x in ids], pa.string())
        ).append_column("decoded_sha256", pa.array([sha256(x.as_py().encode()).hexdigest() for x in decoded], pa.string()))

    return encode(docs, path, ["doc_id"], digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
