"""Packing of documents into sequences by Karmarkar-Karp multiway differencing.

Documents are encoded and cut: whole windows first, the rest into pieces of at most ``PIECE`` tokens.
A block of pieces is divided among a number of windows by differencing: the two partial partitions
with the largest imbalance are merged, the fullest part of one with the emptiest of the other, until
one partition with near-equal parts is left. When a part exceeds the window, the block is divided
again among one window more. Blocks are closed within a task as the documents pass, so nothing is
shuffled and a task holds one block and one document at a time.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditloom.llm.common import utf8

WINDOW = 2048
#: Tokens of a piece at most; shorter pieces balance better, longer ones cut documents less.
PIECE = 512
#: Pieces of a block, and the tokens that its windows leave free on average.
BLOCK = 1500
SLACK = 6
#: Id that ends every document.
END = 1
#: Bytes of known words and chunks that a task holds, bytes of text that are split at a time, words encoded at a time.
MEMORY = 256 << 20
SLICE = 1 << 20
TOGETHER = 5000
#: Rows whose texts are encoded before they are packed.
ROWS = 500
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Fixed values of the tokenizer: the mark of a word's last piece, and its words as far as Latin-1 has their characters.
WORD_END = "</w>"
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe\x09-\x0d\x20\x85\xa0]+").findall
#: Chunks that are encoded by themselves: beyond Latin-1 (in UTF-8), or with the start of a special token, which is looked
#: for before letters are lower-cased.
APART = re.compile(rb"[\xc4-\xff]|<\|").search


class Encoder:
    """Ids of whole texts, put together from those of their chunks between ASCII white space.

    The tokenizer drops white space and matches nothing across it, so a text's ids are those of its
    chunks. A chunk in Latin-1 is cut into the words the tokenizer would cut it into (NFC changes none of
    these characters); distinct words are encoded many at a time, and told apart by the word end that
    exactly the last id of each has. Other chunks are encoded by themselves. What is known is
    forgotten when it holds more than ``MEMORY`` bytes.
    """

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def of(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of every text (little-endian unsigned 32-bit)."""
        out, first, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= SLICE:
                out += self._some(texts[first:i]) + [self._long(text)]
                first, size = i + 1, 0
        return out + self._some(texts[first:])

    def _long(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            space = BLANK.search(text, at + SLICE)
            upto = space.start() if space else len(text)
            out += self._some([text[at:upto]])
            at = upto
        return b"".join(out)

    def _some(self, texts: Sequence[bytes]) -> list[bytes]:
        if self.held > MEMORY:
            self.chunks.clear()
            self.words.clear()
            self.held = 0
        split = [text.split() for text in texts]
        self._learn(set().union(*split).difference(self.chunks))
        return [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in split]

    def _learn(self, chunks: set[bytes]) -> None:
        alone = list(filter(APART, chunks))
        for i in range(0, len(alone), TOGETHER):
            part = alone[i : i + TOGETHER]
            found = self.encode([c.decode() for c in part], add_special_tokens=False)
            self._hold(self.chunks, part, [np.array(x.ids, dtype="<u4").tobytes() for x in found])
        cut = list(chunks.difference(alone))
        words = list(map(WORDS, b"\n".join(cut).decode().lower().split("\n"))) if cut else []
        new = list(set().union(*words).difference(self.words))
        for i in range(0, len(new), TOGETHER):
            part = new[i : i + TOGETHER]
            ids = np.array(self.encode([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = [0, *(4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            self._hold(self.words, part, [raw[a:b] for a, b in pairwise(ends)])
        known = self.words
        self._hold(self.chunks, cut, [known[w[0]] if len(w) == 1 else b"".join(map(known.__getitem__, w)) for w in words])

    def _hold(self, known: dict, words: Sequence, ids: Sequence[bytes]) -> None:
        known.update(zip(words, ids, strict=True))
        self.held += 200 * len(words) + sum(map(len, words)) + sum(map(len, ids))


#: A worker process goes on with what its earlier tasks have learned.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def differencing(sizes: Sequence[int], k: int) -> list[list[int]]:
    """The places of ``sizes`` in ``k`` groups of near-equal sums.

    A partial partition is the ascending list of its parts as (sum above the smallest part, places);
    parts that are still empty are not listed.
    """
    heap: list = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, order, b = heapq.heappop(heap)
        overlap = len(a) + len(b) - k  # parts that are taken in both
        if overlap > 0:
            met = [(x + y, (p, q)) for (x, p), (y, q) in zip(a[:overlap], reversed(b[:overlap]), strict=True)]
            merged = sorted(met + a[overlap:] + b[overlap:], key=_sum)
        else:
            merged = sorted(a + b, key=_sum)
        if len(merged) == k and merged[0][0]:
            low = merged[0][0]
            merged = [(total - low, places) for total, places in merged]
        heapq.heappush(heap, (-merged[-1][0], order, merged))
    groups = [_leaves(places) for _, places in heap[0][2]] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def _sum(part: tuple) -> int:
    return part[0]


def _leaves(places: tuple | int) -> list[int]:
    out, left = [], [places]
    while left:
        top = left.pop()
        if isinstance(top, tuple):
            left += top
        else:
            out.append(top)
    return sorted(out)


def balanced(sizes: Sequence[int], k: int, window: int) -> list[list[int]]:
    """Groups of near-equal sums that fit the window; there are more than ``k`` if k groups don't fit."""
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in group) <= window for group in groups):
            return groups
        k += 1


class Piece:
    """Tokens ``start`` to ``start + length`` of a document."""

    __slots__ = ("doc", "start", "length")

    def __init__(self, doc: tuple, start: int, length: int) -> None:
        self.doc, self.start, self.length = doc, start, length  # doc: (its kept values, its ids)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, length), Piece(self.doc, self.start + length, self.length - length)


class Packer:
    """Fills sequences from a stream of documents: lists of pieces."""

    def __init__(self, window: int, piece: int, block: int, slack: int) -> None:
        self.window, self.piece, self.block, self.slack = window, piece, block, slack
        self.open: list[Piece] = []

    def add(self, doc: tuple, n: int) -> Iterator[list[Piece]]:
        whole = n - n % self.window
        for start in range(0, whole, self.window):
            yield [Piece(doc, start, self.window)]
        self.open += [Piece(doc, start, min(self.piece, n - start)) for start in range(whole, n, self.piece)]
        if len(self.open) >= self.block:
            yield from self._divide()

    def _divide(self) -> Iterator[list[Piece]]:
        """Windows of all open pieces, but for those that would fill less than one; these stay open."""
        pieces, total = self.open, sum(p.length for p in self.open)
        k = total // (self.window - self.slack)
        self.open, rest = [], total - k * (self.window - self.slack)
        while rest:
            last = pieces.pop()
            if last.length > rest:
                kept, last = last.cut(last.length - rest)
                pieces.append(kept)
            rest -= last.length
            self.open.append(last)
        if pieces:
            for group in balanced([p.length for p in pieces], k, self.window):
                if group:
                    yield [pieces[i] for i in group]

    def close(self) -> Iterator[list[Piece]]:
        """What is left; the last tokens, fewer than a window, in sequences of 2^n tokens, which are not padded."""
        yield from self._divide()
        left = sum(p.length for p in self.open)
        queue = self.open[::-1]
        for size in (1 << n for n in reversed(range(left.bit_length())) if left >> n & 1):
            sequence = []
            while size:
                piece = queue.pop()
                if piece.length > size:
                    piece, after = piece.cut(size)
                    queue.append(after)
                size -= piece.length
                sequence.append(piece)
            yield sequence


def pack(
    docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), window: int = WINDOW, piece: int = PIECE,
    block: int = BLOCK, slack: int = SLACK,
) -> DataFrame:
    """``keep`` columns, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id and offset of every piece.

    Every row of ``docs`` (text, ``keep``) is encoded whole by the tokenizer of the file, without adding
    special tokens but with ``END`` after its last id, and cut into pieces; each of its ids is in exactly
    one. A null or empty text is ``END`` alone. Repeated rows are packed each; other columns are ignored.
    A sequence has at most ``window`` tokens, without gaps from offset 0. sequence_id is the number of the
    input partition times 2^33 and a running number, so reading the same partitions gives the same result.
    """
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    names = [*keep, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, number = encoder(path), Packer(window, piece, block, slack), 0
        end = np.array([END], dtype="<u4").tobytes()
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)]
            rows.clear()
            kept = [pa.concat_arrays([batch.column(c).slice(i, 1) for batch, i in columns[0]]) for c in keep]
            ids = pa.array(columns[3], pa.binary())
            longs = [pa.array(columns[k], pa.int64()) for k in (1, 2, 4, 5, 6)]
            return pa.RecordBatch.from_arrays([*kept, *longs[:2], ids, *longs[2:]], names)

        def lay(sequences: Iterator[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    row, ids = p.doc
                    rows.append((row, p.start, p.length, ids[4 * p.start : 4 * (p.start + p.length)], len(ids) // 4, number, offset))
                    offset += p.length
                number += 1
                if len(rows) >= 1000:
                    yield batch_of()

        for batch in batches:
            texts, batch = batch.column("text"), batch.drop_columns(["text"])
            if batch.num_rows and not number:
                number = batch.column("__part")[0].as_py() << 33
            for at in range(0, batch.num_rows, ROWS):
                for i, ids in enumerate(encode.of(list(utf8(texts.slice(at, ROWS)))), at):
                    ids += end
                    yield from lay(packer.add(((batch, i), ids), len(ids) // 4))
        yield from lay(packer.close())
        if rows:
            yield batch_of()

    numbered = docs.select(*[F.col(f"`{c}`") for c in keep], "text").withColumn("__part", F.spark_partition_id())
    return numbered.mapInArrow(
        read, f"{kinds}start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
