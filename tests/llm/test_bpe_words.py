"""Words of the byte-level pattern, cut as whole arrays, against the pattern itself."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import regex

from auditloom.llm import bpe

END = "<|endoftext|>"
PATTERN = regex.compile(bpe.PATTERN).findall
PIECES = [*"''''str   \n\t  \x1c\x85\x001١xÉ你\U0001f600‍!?́\U0001e900lvedm", "re", "ve", "ll", "<|", END]


def by_pattern(text):
    return [w for i, part in enumerate(regex.split(f"({regex.escape(END)})", text)) for w in ([part] if i % 2 else PATTERN(part))]


def assert_cut(split, texts):
    words, counts = split(texts)
    want = [by_pattern(t) for t in texts]
    assert words.to_pylist() == [w for own in want for w in own], texts
    assert counts.tolist() == [len(own) for own in want]


def test_words_are_those_of_the_pattern():
    rng, split = random.Random(4), bpe.Splitter([END])
    for _ in range(5000):
        assert_cut(split, ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 5))])


def test_every_character_has_its_kind():
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert_cut(bpe.Splitter([]), [every, " ".join(every)])


def rows(*texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["__row", "text"])


def test_blocks_close_at_their_size_and_number_words_as_they_come(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 12)
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 5)
    seen = []

    def close(block, kept, words, counts):
        seen.append((block, sum(r.num_rows for r in kept), words.to_pylist(), counts.tolist()))
        if words.num_chunks:
            assert all(c.dictionary.to_pylist() == list(dict.fromkeys(words.to_pylist())) for c in words.chunks)

    list(bpe._reader([], close)(iter([rows("a b", None, "b a a"), rows("c" * 9, "a b c d e f g h", "", "z")])))
    assert seen == [
        (0, 3, ["a", " b", "b", " a", " a"], [2, 0, 3]), (0, 1, ["c" * 9], [1]),
        (1, 1, ["a", *(" " + c for c in "bcdefgh")], [8]), (2, 2, ["z"], [0, 1]),
    ]
    seen.clear()
    list(bpe._reader([], close)(iter([rows(), rows(None, "")])))
    assert seen == [(0, 2, [], [0, 0])]


def test_cutting_is_much_faster_than_matching_the_pattern():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    texts = [t or "" for t in texts]
    split = bpe.Splitter([END])
    split(["x"])

    def seconds(work):
        taken = []
        for _ in range(3):
            start = time.process_time()
            work()
            taken.append(time.process_time() - start)
        return min(taken)

    assert 2 * seconds(lambda: split(texts)) < seconds(lambda: [PATTERN(t) for t in texts])
