"""Ranked search against brute force, and its results in odd cases."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from auditloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, best):
    """docs: (doc_id, text) rows; items: {item_id: set of terms}."""
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, wanted in items.items():
        scored = []
        for i, c in counts:
            if c:
                m = 10 + 90 * sum(c.values()) * n_docs // total
                score = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c
                )
                if score > 0:
                    scored.append((-score, i is None, i or 0, i))
        out[item] = [(k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:best], 1)]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


WORDS = "alpha Beta gamma delta café 你好 2024 x2 the THE of and".split()


def corpus():
    rows = []
    for i in range(400):
        words = [WORDS[(i * 7 + k * k) % len(WORDS)] for k in range(i % 23)]
        rows.append((i, ", ".join(words) + (" the end." if i % 3 else "")))
    return rows + [(None, "alpha Beta"), (7, "alpha alpha"), (7, "alpha alpha"), (401, None), (402, ""), (403, "!?"), (404, "alpha " * 20_000)]


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, score string, rank int")


@pytest.mark.parametrize("postings", [500_000, 4])
def test_search_matches_brute_force(spark, monkeypatch, postings):
    monkeypatch.setattr(search, "ROWS", 7)
    docs = corpus()
    asked = [(1, "Alpha, beta the café"), (2, "2024 of 你好 x2"), (2, "gamma"), (3, None), (4, "nowhere"), (None, "delta delta"), (5, "alpha")]
    frame = spark.createDataFrame([(i, t, 5, "clash") for i, t in docs], "doc_id long, text string, n long, terms string").repartition(5)
    got = found(search.search(frame, items_frame(spark, [(i, t, "s", 1) for i, t in asked]), best=10, postings=postings))
    items = {}
    for i, t in asked:
        items.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    want = brute(docs, items, 10)
    assert got == {i: rows for i, rows in want.items() if rows}
    assert len(got) == 4


def test_ties_go_by_id_and_common_terms_score_nothing(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(30, 0, -1)] + [(99, "other words")], "doc_id long, text string").repartition(7)
    got = found(search.search(docs, items_frame(spark, [(1, "same", "", 0), (2, "words", "", 0)])))
    assert [r[:2] for r in got[1]] == [(k, k) for k in range(1, 11)]
    assert got.get(2, []) == brute([(i, "same words here") for i in range(1, 31)] + [(99, "other words")], {2: {"words"}}, 10)[2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    items = items_frame(spark, [(1, "alpha", "", 0)])
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs, items_frame(spark, [(1, None, "", 0)])).columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r) for r in search.search(docs, items).collect()] == [(1, 1, 1, brute([(1, "alpha")], {1: {"alpha"}}, 1)[1][0][2])]


def test_a_hot_block_is_split_until_it_fits(spark):
    terms = spark.createDataFrame([(i % 40, f"t{i}") for i in range(400)] + [(77, f"u{i}") for i in range(50)], "item_id long, term string")
    n = search._blocks(terms, 30)
    sizes = terms.groupBy("item_id", search._block(n).alias("b")).count().collect()
    for b in {r["b"] for r in sizes}:
        own = [r["count"] for r in sizes if r["b"] == b]
        assert sum(own) <= 30 or len(own) == 1
