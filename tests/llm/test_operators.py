"""Operators against brute force on small tables, and their defined results in odd cases."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import bpe, class_lm, fingerprints, html_text, language, line_dedup, minhash, mixing, quality, queries, toxicity
from auditloom.llm.words import WordHashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, *rows, extra=True):
    """Rows of (doc_id, text, source); with columns whose names clash with results."""
    df = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], KINDS)
    return df.withColumns({"size": F.lit("x"), "kept": F.lit(7), "score": F.lit(None), "n_lines": F.lit(-1)}) if extra else df


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t", None), (4, "one", "b"), (4, "one", "b"), (4, "two words", "b"), (None, "null id here", "a"),
       (None, None, None), (9, "x " * 30_000, "c")]


# near duplicates


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    got = {r[0]: (r[1], r[2]) for r in queries.op1_minhash_near_dedup(spark, SF).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_components(texts_of(spark), 4, 80)


def test_a_large_group_of_near_copies_keeps_all_links(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(90):
        words = list(base)
        for k in range(i % 4):
            words[(7 * i + 13 * k) % 60] = f"edit{i}x{k}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, width=5).collect()}
    assert got == brute_components(texts, 5, 80)


def test_near_duplicates_odd_rows(spark):
    rows = minhash.near_duplicates(documents(spark, *ODD)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, rows)) == Counter([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (4, 1, 4, True),
        (None, 1, None, True), (None, 0, None, True), (9, 1, 9, True),
    ])
    assert minhash.near_duplicates(documents(spark, (1, "a", "b")).limit(0)).count() == 0


# encoding

TRICKY = [
    "it's they'll I'M 'sabc x.'s \n's  two  spaces\n\n new\tline \u00a0nbsp\u2003em", "a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>",
    "caf\u00e9 na\u00efve \u4f60\u597d \U0001f600\U0001f468\u200d\U0001f469 \u0661\u0662 x\u00b2", "   ", "\n", " \n ", "tail   ", "\x00\x1c\x1d\x85 ctrl", "!!??...''ve", "x" * 3000, "1234 5,678",
]


def test_encoding_matches_the_library(spark, tmp_path):
    from public_tokenizers import path as vocabulary
    from tokenizers import Tokenizer

    path = vocabulary(queries.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    rows = [*ODD, *[(100 + i, t, "s") for i, t in enumerate(TRICKY)]]
    documents(spark, *rows).write.parquet(str(tmp_path / "docs"))
    encoded = bpe.encode(spark.read.parquet(str(tmp_path / "docs")), path, ["doc_id", "n_chars"])
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["text"]) for r in bpe.decode(encoded, path).collect())
    want = Counter()
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.encode(spark.read.parquet(str(tmp_path / "docs")).filter("doc_id = -1"), path).count() == 0


def test_encoding_of_whole_documents(spark):
    import hashlib

    from public_tokenizers import path as vocabulary
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(queries.TOKENIZER))
    texts = texts_of(spark)
    for r in queries.op2_bpe_round_trip(spark, SF).collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


class Tables:
    """Stands for the DataFrame of vocabularies and hands out what a task would run."""

    def __getattr__(self, name):
        return lambda *a, **k: self

    def mapInArrow(self, function, kinds):
        return function


def vocabulary_rows(parts):
    """Rows of (block, part, numbers, sizes, letters) for (part, words), one batch."""
    import numpy as np
    import pyarrow as pa

    packed = [[bpe._packed(np.array(x, np.uint32)) for x in (range(len(w)), list(map(len, w)))] for _, w in parts]
    letters = [bpe._squeezed("".join(w).encode()) for _, w in parts]
    columns = [list(range(len(parts))), [p for p, _ in parts], [n for n, _ in packed], [s for _, s in packed], letters]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "part", "numbers", "sizes", "letters"])


def test_encoding_loads_the_tokenizer_once_for_many_tasks(monkeypatch, tmp_path):
    import shutil

    from public_tokenizers import path as vocabulary

    class Loads:
        paths = []

        @classmethod
        def from_file(cls, path):
            cls.paths.append(path)
            return tokenizer_class.from_file(path)

    tokenizer_class = bpe.Tokenizer
    monkeypatch.setattr(bpe, "Tokenizer", Loads)
    own = shutil.copyfile(vocabulary(queries.TOKENIZER), tmp_path / "own.json")
    for task in range(5):
        batch = vocabulary_rows([(0, [f" word{task}", "a"]), (0, ["a", "b"])])
        out = list(bpe.encode_words(Tables(), str(own))(iter([batch])))
        assert sum(b.num_rows for b in out) == 2
    assert len(Loads.paths) == 1
    # A file that was replaced meanwhile is another tokenizer.
    shutil.copyfile(vocabulary(queries.WORD_TOKENIZER), own)
    list(bpe.encode_words(Tables(), str(own))(iter([batch])))
    assert len(Loads.paths) == 2


def test_encoding_holds_the_words_of_one_part_at_a_time():
    import tracemalloc

    from public_tokenizers import path as vocabulary

    path = vocabulary(queries.TOKENIZER)
    parts = [(p, [f" w{p}x{i}" for i in range(4000)]) for p in range(16)]

    def peak(rows):
        task = bpe.encode_words(Tables(), path)
        batches = [vocabulary_rows([row]) for row in rows]
        list(task(iter(batches[:1])))
        tracemalloc.start()
        try:
            for batch in task(iter(batches)):
                del batch
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(parts) < 2 * peak(parts[:1])


def test_parts_reach_their_task_one_after_the_other(spark):
    from public_tokenizers import path as vocabulary

    rows = spark.range(400).selectExpr(
        "id as block", "cast(id % 64 as int) as part", "cast('' as binary) as numbers", "cast('' as binary) as sizes", "cast('' as binary) as letters"
    )
    plan = bpe.encode_words(rows, vocabulary(queries.TOKENIZER))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"MapInArrow.*\n.*Sort \[part.*\], false", plan)


# class model


def test_class_model_base_scores_and_gain(spark):
    import math

    texts = texts_of(spark)
    train = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update([*WORD.findall((t or "").translate(LOWER)), None])
    n, v = sum(train.values()), len(train)
    gain = []
    for r in queries.op6_class_lm(spark, SF).collect():
        tokens = [*WORD.findall((texts[r["doc_id"]] or "").translate(LOWER)), None]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel=1e-9)
        assert r["score"] < 0
        if r["held_out"]:
            gain.append((r["score"] - r["base_score"]) / r["n_tokens"])
    assert sum(gain) / len(gain) > 0


def test_class_model_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(class_lm, "HELD", 3)  # nearly all counts come by the join
    df = documents(spark, *ODD, (20, "two words two", "a"))
    model, counts = class_lm.learn(df)
    rows = class_lm.score(df, model, counts, F.lit(False)).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        assert r["n_known"] == r["n_tokens"] and r["score"] <= 0
    empty = df.limit(0)
    model, counts = class_lm.learn(empty)
    assert class_lm.score(empty, model, counts, F.lit(True)).count() == 0
    assert {r["n_known"] for r in class_lm.score(df, model, counts, F.lit(True)).collect()} == {0}


def test_class_probabilities_sum_to_one():
    pairs = np.random.default_rng(0).integers(0, 5, (class_lm.CLASSES, class_lm.CLASSES)).astype(float)
    assert class_lm.smoothed_transitions(pairs).sum(1) == pytest.approx(np.ones(class_lm.CLASSES))


# quality rules


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_match_brute_force(spark):
    texts = texts_of(spark)
    for r in queries.op3_quality_rules(spark, SF).collect():
        want = brute_quality(texts[r["doc_id"]])
        assert tuple(r[1:6]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])


def test_line_rules():
    def rule(line):
        return quality.failed_rule(line, len(line.split()))

    assert rule("Home | About | Contact | Imprint") == "navigation"
    assert rule("Read more") == "punctuation"
    assert rule("All rights reserved.") == "boilerplate"
    assert rule("Buy!! now!! cheap!! pills!!") == "punctuation"
    assert rule("A sentence that ends as one should.") is None
    text = "A good line with quite a few words in it that ends well.\n" * 1 + "menu | home | about\nOne more line that ends as prose does, with a stop.\n"
    found = quality.measure(text, WordHashes())
    assert found["cleaned"] == text.replace("menu | home | about\n", "") and found["kept"]


def test_quality_odd_rows(spark):
    rows = quality.clean(documents(spark, *ODD)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["base_failed"] and not r["kept"]
    long = next(r for r in rows if r["doc_id"] == 9)
    assert (long["n_words"], long["n_repeat_words"]) == (30_000, 30_000)


# line dedup


def brute_lines(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows.items()):
        lines = text.split("\n")
        held = [i for i, line in enumerate(lines) if WORD.search(line)]
        gone = set()
        for k in range(len(held) - 2):
            window = tuple(lines[i] for i in held[k : k + 3])
            if window in seen:
                gone |= set(range(held[k], held[k + 2] + 1))
            seen.add(window)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_line_dedup_matches_brute_force(spark):
    got = {r[0]: tuple(r[1:]) for r in queries.op8_line_dedup(spark, SF).collect()}
    assert got == brute_lines(texts_of(spark))
    assert any(x[2] for x in got.values())


def test_line_dedup_keeps_the_first_and_merges_windows(spark):
    df = documents(spark, (2, "x\na\nb\n\nc\nd\ny", "s"), (1, "a\nb\nc\nd\nq", "s"), (3, "a\nb", "s"))
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert [rows[i]["text"] for i in (1, 2, 3)] == ["a\nb\nc\nd\nq", "x\ny", "a\nb"]
    assert rows[2]["n_removed"] == 5 and rows[2]["kept"] == 7


def test_line_dedup_odd_rows(spark):
    rows = line_dedup.dedup_lines(documents(spark, *ODD)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i, t) for i, t, _ in ODD)
    assert line_dedup.dedup_lines(documents(spark, (1, "a", "b")).limit(0)).count() == 0


# mixing


def test_mix_meets_targets(spark):
    rows = queries.op7_mixing(spark, SF).collect()
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        s = sources[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    for s, want in target.items():
        assert abs(taken[s] - want) <= 2 * largest[s]
    assert Counter(rows) == Counter(queries.op7_mixing(spark, SF).collect())


def test_source_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 1000), ("c", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 20.0, "b": 200.0, "c": 0.0, None: 1445.0}


def test_mix_odd_rows(spark):
    rows = mixing.mix(documents(spark, *ODD)).collect()
    assert len(rows) == len(ODD)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(documents(spark, (1, "a", "b")).limit(0)).count() == 0
    empty = mixing.mix(documents(spark, (1, None, "a"), (2, "", None))).collect()
    assert [r["taken"] for r in empty] == [0, 0]


# fingerprints


def likeness(a, b):
    a, b = ({x for x in t.split("\n") if WORD.search(x)} for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(rows, texts):
    import hashlib

    order = sorted(texts)
    by_text = defaultdict(set)
    assert sorted(r["doc_id"] for r in rows) == order
    for r in rows:
        own = texts[r["doc_id"]] or ""
        following = texts[order[(order.index(r["doc_id"]) + 1) % len(order)]] or ""
        edited = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(own, edited))
        assert r["near_next"] == pytest.approx(likeness(own, following))
        by_text[own].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
    assert all(len(found) == 1 for found in by_text.values())


def test_fingerprints_match_brute_force(spark):
    check_fingerprints(queries.op4_fingerprints(spark, SF).collect(), texts_of(spark))


def test_fingerprints_retry_and_odd_rows(spark):
    lines = ["line %d of a long text" % i for i in range(900)]
    texts = {1: None, 2: "", 3: " \n\t", 4: "one", 9: "\n".join(lines), 10: "\n".join(lines[:450] + lines[:3]), 11: "\n".join(lines[400:])}
    rows = [(i, t, "s") for i, t in texts.items()] + [(4, "one", "s"), (None, "no id", "s")]
    check_fingerprints(fingerprints.fingerprints(documents(spark, *rows)).collect(), texts)
    one = fingerprints.fingerprints(documents(spark, (1, "a\nb", "s"))).collect()
    assert one[0]["near_next"] == 1.0
    assert fingerprints.fingerprints(documents(spark, (1, "a", "b")).limit(0)).count() == 0


# pipeline


def test_pipeline_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline
    from auditloom.llm.common import table

    docs = table(spark, SF, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    texts = texts_of(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        if name == "bpe":
            break
        assert docs.columns == corpus_pipeline.COLUMNS
        after = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert set(after) <= set(before)
        if name == "language_id":
            assert len(after) >= 0.99 * len(texts)
        elif name == "line_dedup":
            want = brute_lines(before)
            assert {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} == {
                i: t for i, (t, _, gone) in want.items() if not gone or WORD.search(t)
            }
        elif name == "near_dedup":
            groups = brute_components(before, 5, 80)
            assert set(after) == {i for i, (_, home) in groups.items() if i == home}
        elif name == "mixing":
            assert max(after.values()) <= 2
    for r in docs.select("doc_id", "decoded").collect():
        assert r["decoded"] == before[r["doc_id"]]


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline

    for rows, n in ((ODD, "odd"), (ODD[:0], "empty")):
        docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], KINDS)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"{n}-{name}")
        assert docs.count() >= 0


# pages

PAGE = """<html lang=en><head><title>T</title><script>if (a<b) {"</p>"}</script></head><body>
<header><h1>Site</h1></header><div class="cookie-notice">We use cookies. Accept them all, please, it is good for you.</div>
<nav><a href=/>Home</a></nav><article><h1>Head &amp; line</h1><p>First <b>para</b>graph with a good number of words, enough
for a surge of text.<aside>Aside</aside><p>Short.</p><form><input>Mail</form><p>Last &lt;one&gt;&nbsp;here.</p>
<section id="comments"><p>First! A reader says something long enough to be taken for text of the page.</p></section></article>
<footer>&copy; me</footer>"""


def test_main_text():
    want = "Head & line\nFirst paragraph with a good number of words, enough for a surge of text.\nShort.\nLast <one> here."
    assert html_text.main_text(PAGE) == want
    plain = re.sub(r"</?article>", "", PAGE).replace("<nav>", "<div>").replace("</nav>", "</div>")
    assert html_text.main_text(plain) == want
    assert html_text.main_text("") == html_text.main_text("<p></p><!-- x") == ""
    assert html_text.main_text("just text") == "just text"


def test_sums_choose_the_text_of_marked_pages():
    long = "A paragraph that is long enough to be the text of its page, by itself. " * 6
    apart = f"<article><p>Weak.</p><nav>Menu</nav><p>{long}</p></article>"
    assert html_text.main_text(apart) == html_text.main_text(apart.replace("article", "div")) == long.strip()
    beside = f"<main><p>Teaser.</p></main><nav>Menu</nav><div><p>{long}</p></div><nav>Menu</nav><p>Small print.</p>"
    assert html_text.main_text(beside) == long.strip()


def test_only_open_tags_mark_an_article():
    text = "Text of the page, some words of it."
    for other in ("<!-- <article> -->", "<script>x = '<main>'</script>", "<main-menu></main-menu>", "</article>"):
        assert html_text.lines_of(f"{other}<p>{text}</p>")[-1] == (text, len(text))
        assert html_text.main_text(f"{other}<p>{text}</p>") == text
    links = "<p>See <a href=/x>the whole report of the year</a></p>"
    assert html_text.main_text(f"<article><p>{text}</p>{links}<p>{text}</p></article>") == f"{text}\nSee the whole report of the year\n{text}"


def test_pages_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (None, None, "<p>x", 5), (2, "u", "", 5), (2, "u", "", 5)], "page_id long, url string, html string, text long")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()) == [
        ("1", "", 0), ("2", "", 0), ("2", "", 0), ("None", "x", 1)]


# language


def test_languages_of_documents_and_pages(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op9_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    assert sum(lang[r["doc_id"]] == r["text_language"] for r in rows) >= 0.95 * len(rows)
    assert sum(r["kept"] for r in rows) >= 0.99 * len(rows)
    pages = queries.page_languages(spark, SF).collect()
    assert sum(r["kept"] for r in pages) >= 0.99 * len(pages)


def test_every_label_is_a_language(spark):
    names = [f"l{i:02d}" for i in range(40)]
    rows = [(i * 1000 + k, " ".join(f"{a}{b}{a}" for b in "aeiou") + f" {a}{a}", name)
            for i, name in enumerate(names) for a in [chr(98 + i % 20) + chr(98 + i // 20)] for k in range(40 - i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels, model = language.trigram_model(language.labelled_sample(docs, "lang"))
    assert labels == names and model.shape == (language.GRAMS, 40)
    facts = docs.select("doc_id", "text", "lang", F.lit("").alias("__declared"), F.lit("").alias("__host"))
    found = language.identify(facts, labels, model, ["lang"]).collect()
    assert all(r["text_language"] == r["lang"] for r in found)


def test_declared_host_and_suffix_decide_unclear_texts(spark):
    labels, model = language.trigram_model(spark.createDataFrame([("de", "der die das und nicht " * 40), ("en", "the and of this that " * 40)], "label string, text string"))
    rows = [(i, "der die das und nicht", "de", "a.example.de") for i in range(30)] + [(i, "the and of this that", "en", "b.example.com") for i in range(30, 60)]
    rows += [(100, "qqx", "de", "x.example.de"), (101, "qqx", "en", "y.example.com"), (102, "", "de", "a.example.de"), (103, None, None, None), (104, "qqx", None, "a.example.de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __declared string, __host string")
    got = {r["doc_id"]: r for r in language.identify(df, labels, model, ["doc_id"]).collect()}
    assert (got[100]["language"], got[101]["language"], got[104]["language"]) == ("de", "en", "de")
    assert not got[102]["kept"] and not got[103]["kept"] and got[103]["language"] is None
    only = {r["doc_id"]: r["kept"] for r in language.identify(df, labels, model, ["doc_id"], allowed=["en"]).collect()}
    assert only[30] and not only[0]
    assert language.identify(df.limit(0), labels, model, ["doc_id"]).count() == 0
    assert not any(r["kept"] for r in language.identify(df, [], model, ["doc_id"]).collect())


def test_address_parts(spark):
    row = spark.createDataFrame([("https://u@Www.Example.co.de:80/a?b", "<HTML dir=ltr lang='de-AT'>"), (None, None)], "url string, html string").select(
        language.host_of(F.col("url")), language.domain_of(language.host_of(F.col("url"))), language.suffix_of(language.host_of(F.col("url"))), language.declared_in(F.col("html"))
    ).collect()
    assert tuple(row[0]) == ("www.example.co.de", "co.de", "de", "de") and row[1][0] == ""


# toxicity


def test_toxicity_on_held_out_rows_and_misspellings():
    plain = ["the cat sat on the mat and saw a bird today %d" % i for i in range(60)]
    bad = ["the cat sat on the mat and saw a stupid idiot %d" % i for i in range(60)]
    model = toxicity.train(plain + bad, [0] * 60 + [1] * 60)
    scores = toxicity.WordScores(model).of(["the mat and a stupid cat", "a stuppid idiots cat", "a bird on the mat", ""])
    assert scores[0] > 0.5 and scores[1] > 0.5 and scores[2] < 0.3
    assert 0 <= scores[3] <= 1


def test_toxicity_learns_words_of_a_single_text():
    plain = ["the cat sat on the mat and saw a bird today %d" % i for i in range(60)]
    bad = ["the cat sat on the mat and saw a stupid idiot %d" % i for i in range(59)] + ["the cat sat on the mat and saw a zorqvux zorqvux 59"]
    scores = toxicity.WordScores(toxicity.train(plain + bad, [0] * 60 + [1] * 60)).of(["the mat and a zorqvux cat", "the mat and a cat"])
    assert scores[0] > scores[1]


def test_toxicity_odd_rows(spark):
    df = documents(spark, *ODD)
    model = toxicity.train([], [])
    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    labels = spark.createDataFrame([(4, 1), (9, 0), (None, 1), (2, None), (77, 0)], "doc_id long, toxic int")
    assert toxicity.learn(df, labels, F.lit(True)).bias is not None


def test_toxicity_never_learns_held_out_labels(spark):
    rows = {r["doc_id"]: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
