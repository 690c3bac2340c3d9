"""Evidence fusion against plain numpy, the bounded sample, and many labels."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import language


def plain_fusion(rows, labels, model):
    """Posterior of every row by the formulas of the module, row by row."""
    n = len(labels)
    likelihoods = []
    for text, *_ in rows:
        grams = language.trigrams((text or "").encode())
        likelihoods.append(np.asarray(model[grams].sum(0), dtype=np.float64) / language.TRIGRAMS_PER_OBSERVATION if len(grams) else None)

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    own = [np.zeros(n) if x is None else softmax(x) for x in likelihoods]
    parts = []
    for _, declared, host in rows:
        host = host or ""
        pieces = host.split(".")
        parts.append((declared or "", host, ".".join(pieces[-2:]) if host else "", pieces[-1] if len(pieces) > 1 else ""))
    sums = {}
    for mass, keys in zip(own, parts):
        for k, key in enumerate(keys):
            sums[k, key] = sums.get((k, key), 0) + mass
    everything = sum(own)

    def share(counts, prior, weight=language.PRIOR_WEIGHT):
        return (counts + weight * prior) / (counts.sum() + weight)

    out = []
    for mass, x, keys in zip(own, likelihoods, parts):
        if x is None:
            out.append((None, 0.0))
            continue
        less = [np.maximum(sums[k, key] - mass, 0) for k, key in enumerate(keys)]
        of_all = share(np.maximum(everything - mass, 0), np.full(n, 1 / n))
        prior = of_all if keys[1] == "" else share(less[1], share(less[2], of_all))
        total = x + np.log(prior)
        for k in (0, 3):
            if keys[k]:
                total = total + np.log(share(less[k], of_all, 1.0) / of_all)
        fused = softmax(total)
        out.append((labels[int(fused.argmax())], float(fused.max())))
    return out


def test_fusion_equals_plain_numpy(spark):
    rng = np.random.default_rng(5)
    words = {"de": "der die das und nicht ein".split(), "en": "the and of this that is".split(), "fr": "le la les et est une".split()}
    train = [(name, " ".join(rng.choice(found, 60))) for name, found in words.items() for _ in range(4)]
    labels, model = language.trigram_model(spark.createDataFrame(train, "label string, text string"))
    rows = []
    for i in range(120):
        name = rng.choice(list(words))
        text = " ".join(rng.choice(words[rng.choice([name, name, "en"])], int(rng.integers(0, 4))))
        rows.append((text or None, rng.choice([name, "en", "", None]), rng.choice([f"a{i % 5}.example.{name}", f"b.x.{name}", "", "localhost", None])))
    rows = [(t, None if d is None else str(d), None if h is None else str(h)) for t, d, h in rows]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, __declared string, __host string").repartition(5)
    got = {r["doc_id"]: (r["language"], r["confidence"]) for r in language.identify(frame, labels, model, ["doc_id"]).collect()}
    for i, (name, confidence) in enumerate(plain_fusion(rows, labels, model)):
        assert got[i][0] == name and got[i][1] == pytest.approx(confidence, abs=1e-9)


def test_sums_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    rows = spark.createDataFrame([([i / 7.0, 1.0 - i / 7.0], f"h{i % 3}", "") for i in range(8)], "posterior array<double>, a string, b string")
    want = sorted((r["kind"], r["key"], [round(x, 9) for x in r["total"]]) for r in language._sums(rows, ["a", "b"], 2).collect())
    monkeypatch.setattr(language, "HELD", 1)
    assert sorted((r["kind"], r["key"], [round(x, 9) for x in r["total"]]) for r in language._sums(rows.repartition(3), ["a", "b"], 2).collect()) == want
    assert [w for w in want if w[0] == ""][0][2] == pytest.approx([4.0, 4.0])


def test_sample_takes_the_smallest_hashes(spark):
    docs = spark.createDataFrame([(f"text number {i % 700}", "a" if i % 5 else "b") for i in range(3000)] + [("only", "c"), (None, "c"), ("x", None)], "text string, lang string")
    got = language.labelled_sample(docs, "lang", 50).collect()
    known = {(r["lang"], r["text"], r["h"]) for r in docs.filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text")).collect()}
    want = set()
    for name in "abc":
        want |= {(name, t) for _, t in sorted((h, t) for label, t, h in known if label == name)[:50]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_many_labels_end_soon(spark):
    names = [f"l{i:03d}" for i in range(800)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(2 * i + k, " ".join(letters[i % 26] + letters[i // 26 % 26] + v + letters[(i + 13 * (i // 676)) % 26] for v in "aeiouaeiou"), name, f"{name}.example.x{i % 9}")
            for i, name in enumerate(names) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    start = time.monotonic()
    labels, model = language.trigram_model(language.labelled_sample(docs, "lang"))
    assert labels == names
    facts = docs.select("doc_id", "text", "lang", F.col("lang").alias("__declared"), F.col("host").alias("__host"))
    found = language.identify(facts, labels, model, ["lang"]).collect()
    assert len(found) == len(rows) and sum(r["language"] == r["lang"] for r in found) >= 0.95 * len(rows)
    assert time.monotonic() - start < 120
