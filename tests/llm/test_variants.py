"""Spelling variants against brute force, and their results in odd cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditloom.llm import queries, variants
from tests.llm.test_operators import ODD, SF, documents, texts_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_variants(n):
    letters = sorted({c for w in n for c in w})
    by_cut = defaultdict(set)  # words with one code point cut out
    for w in n:
        for i in range(len(w)):
            by_cut[(i, w[:i] + w[i + 1 :])].add(w)
    near = {}
    for w in n:
        found = set()
        for i in range(len(w)):
            found |= by_cut[(i, w[:i] + w[i + 1 :])]
            found |= {w[:i] + w[i + 1 :]} & n.keys()
        for i in range(len(w) + 1):
            found |= {w[:i] + c + w[i:] for c in letters} & n.keys() if len(letters) < 60 else by_cut.get((i, w), set())
        near[w] = found - {w}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n}


def rows_of(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_crcs_of_runs_after_any_start():
    words, start = variants._Words(), zlib.crc32(b"12345:")
    runs = ["a", "abc", "été", "x" * 64, "y" * 65, "z" * 500, ""]
    numbers = np.array([words[r] for r in runs])
    assert variants._crcs(start, runs, numbers, words).tolist() == [zlib.crc32(b"12345:" + r.encode()) for r in runs]


def test_variants_of_whole_documents(spark):
    want = brute_variants(brute_counts(texts_of(spark).items()))
    got = rows_of(queries.op11_spelling_variants(spark, SF))
    assert got == want
    assert any(v[0] for v in got.values()) and any(v[3] > 1 for v in got.values())


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_variants_match_brute_force_over_any_partitions(spark, partitions):
    """Few letters, so that words have many neighbours, equal letters in a row and long chains, and tries cross partitions."""
    rng = random.Random(partitions)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([5, 5, 6, 7]))) for _ in range(500)} | {"aaaaa", "aaaaaa", "aaaaaaa", "aaaaa" * 300, "aaaaa" * 299 + "aaaa"}
    n = {w: 3 + int(2 ** rng.uniform(0, 9)) for w in words}
    saved = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert got == brute_variants(n)


def test_a_large_group_and_a_long_chain(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xDF, 0x100)]]
    n = {f"house{c}": 3 + i for i, c in enumerate(letters)} | {"house": 1000}
    chain = "abcdefghij"
    for i in range(9):  # every word but the last points at the next, twice as frequent
        n["zzzz" + "".join(reversed(chain[: i + 1]))] = 5 * 2 ** (i + 1)
    n["house0"] = 3
    got = rows_of(variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute_variants(n)
    assert got["house"][3] == len(letters) + 1
    assert got["zzzza"][1] == "zzzzihgfedcba"


def test_counting_forgets_and_slices(spark, monkeypatch):
    rows = [(i, f"alpha Beta-gamma Gamma {'delta' * (i % 3)} épées x{'y' * i}") for i in range(200)] + [(None, "alpha alphas ALPHA")] * 3 + [(3, None), (4, "")]
    want = brute_counts(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for memory, size in ((variants.MEMORY, variants.SLICE), (500, 7)):
        monkeypatch.setattr(variants, "MEMORY", memory)
        monkeypatch.setattr(variants, "SLICE", size)
        parts = list(variants._slices("ab cd " * 10 + "e" * 30))
        assert "".join(parts) == "ab cd " * 10 + "e" * 30 and (size > 100 or len(parts) > 3)
        assert {r["word"]: r["n"] for r in variants.word_counts(df).collect()} == want


def test_variants_odd_rows(spark):
    df = documents(spark, *ODD, *[(20 + i, "words Words wordé wordss", "s") for i in range(4)]).withColumnRenamed("score", "word").drop("size")
    got = rows_of(variants.spelling_variants(df))
    assert got == brute_variants(brute_counts([(i, t) for i, t, _ in ODD] + [(20 + i, "words Words wordé wordss") for i in range(4)]))
    empty = variants.spelling_variants(documents(spark, (1, "a", "b")).limit(0))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
    assert variants.spelling_variants(documents(spark, (1, "short", "s"))).count() == 0
