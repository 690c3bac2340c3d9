"""Packing: every id once, as the library encodes, in windows that differencing balances."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditloom.llm import packing, queries
from tests.llm.test_operators import ODD, SF, TRICKY, documents, texts_of

PATH = vocabulary(queries.WORD_TOKENIZER)
HARD = [
    *TRICKY, "<|ENDOFTEXT|> <|endoftext|>. a<|startoftext|>b", "It's l'eau, l'ÉTÉ! x²½ ªºµ ×÷", "a b\x85c \x1c\x1d d\x1fe",
    "été İstanbul Σσς ﬁn ẞ", "~ ~~ ~a~ 'll 'LL y'all'd've", "don't ''s' 's.'t", "end.).,;:!?) (x) .5 5. 5,000.00!", "\x00\x01a\x7f", "\U0001f600.你好,",
]


def want_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def check_packed(rows, texts, window):
    """rows: (doc_id, start, ids, doc_tokens, sequence_id, offset); texts: (doc_id, ids) of every input row."""
    sequences = defaultdict(list)
    by_doc = defaultdict(lambda: defaultdict(list))
    for doc_id, start, ids, n, sequence, offset in rows:
        sequences[sequence].append((offset, len(ids)))
        by_doc[doc_id][start].append(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    want = defaultdict(lambda: defaultdict(int))
    for doc_id, ids in texts:
        for k, x in enumerate(ids):
            want[doc_id][(k, x)] += 1
    got = defaultdict(lambda: defaultdict(int))
    for doc_id, starts in by_doc.items():
        for start, found in starts.items():
            for ids in found:
                for k, x in enumerate(ids, start):
                    got[doc_id][(k, x)] += 1
    assert got == want
    return [sum(length for _, length in pieces) for pieces in sequences.values()]


def test_encoder_equals_the_library(monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [*HARD, " ".join(HARD), "\t".join(HARD).upper(), "", "x" * 5000, "word " * 300]
    for settings in ({}, {"SLICE": 40, "TOGETHER": 3, "MEMORY": 2000}):
        for name, value in settings.items():
            monkeypatch.setattr(packing, name, value)
        encoder = packing.Encoder(PATH)
        for _ in range(2):
            for text, ids in zip(texts, encoder.of([t.encode() for t in texts]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def test_latin_1_words_are_the_tokenizers_own():
    tokenizer = Tokenizer.from_file(PATH)
    encoder = packing.Encoder(PATH)
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(1, 256)) for _ in range(60)) for _ in range(400)]
    for text, ids in zip(texts, encoder.of([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_whole_documents_are_packed_with_little_padding(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = {i: want_ids(tokenizer, t) for i, t in texts_of(spark).items()}
    packed = packing.pack(queries.table(spark, SF, "documents"), PATH).collect()
    rows = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in packed]
    sizes = check_packed(rows, texts.items(), packing.WINDOW)
    padded = sum(n if n & (n - 1) == 0 else packing.WINDOW for n in sizes)
    assert sum(sizes) / padded >= 0.98
    assert all(len(texts[r["doc_id"]]) == r["doc_tokens"] for r in packed)
    digests = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in queries.op12_packing(spark, SF).collect()}
    assert digests == {(r["doc_id"], r["start"]): (r["length"], zlib.crc32(r["ids"])) for r in packed}


def test_packing_odd_rows(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [*ODD, *[(100 + i, t, "s") for i, t in enumerate(HARD)]]
    df = documents(spark, *rows).withColumns({"start": F.lit("x"), "ids": F.lit(1), "offset": F.lit(2)}).repartition(3)
    for window, piece, block, slack in ((2048, 512, 1500, 6), (64, 16, 9, 2), (10, 10, 3, 0), (1, 1, 1, 0)):
        packed = packing.pack(df, PATH, window=window, piece=piece, block=block, slack=slack).collect()
        got = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in packed]
        check_packed(got, [(i, want_ids(tokenizer, t)) for i, t, _ in rows], window)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_differencing_balances_better_than_filling_in_turn():
    rng = random.Random(1)
    for n, k in ((0, 3), (1, 4), (3, 3), (40, 7), (400, 50)):
        sizes = [rng.randrange(1, 512) for _ in range(n)]
        groups = packing.differencing(sizes, k)
        assert len(groups) == k and sorted(i for g in groups for i in g) == list(range(n))
        sums = [sum(sizes[i] for i in g) for g in groups]
        turn = [sum(sizes[i::k]) for i in range(k)]
        assert max(sums) - min(sums) <= max(turn) - min(turn)
    assert max(sums) - min(sums) <= 20  # 400 sizes of up to 511 in 50 groups
    # The textbook case: 8, 7, 6, 5, 4 differ by 2 after differencing into two.
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_the_number_of_windows_rises_when_one_is_exceeded():
    groups = packing.balanced([7, 7, 7], 2, 10)  # 21 tokens fit two windows of 10 and one more, but no two sizes fit one
    assert len(groups) == 3 and all(len(g) == 1 for g in groups)
