"""Near duplicates where an id comes with several texts."""

from __future__ import annotations

from collections import Counter

from auditloom.llm import minhash


def brute(rows, width, percent):
    """(doc_id, text) rows as nodes: component id is the smallest id among the rows that links reach."""
    sets = []
    for _, text in rows:
        w = text.lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    home = list(range(len(rows)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * len(sets[i] | sets[j]):
                home[find(i)] = find(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        lowest[find(i)] = min(doc_id, lowest.get(find(i), doc_id))
    return Counter((doc_id, lowest[find(i)]) for i, (doc_id, _) in enumerate(rows))


def text(group, changed, n=60):
    words = [f"g{group}w{i}" for i in range(n)]
    for i in changed:
        words[i] = f"x{group}c{i}"
    return " ".join(words)


def test_ids_that_repeat_with_other_texts(spark):
    """Groups of A, C (not alike enough) and B, which is between them, under A's id; and whole rows that repeat."""
    rows = []
    for g in range(12):
        a, c, b = text(g, []), text(g, [10, 30, 45]), text(g, [10, 45])
        rows += [(10 * g, a), (10 * g + 1, c), (10 * g, b), (10 * g, b), (5, text(g, range(0, 60, 2)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = minhash.near_duplicates(frame).select("doc_id", "component_id").collect()
    assert Counter(map(tuple, found)) == brute(rows, minhash.WIDTH, minhash.MIN_PERCENT)


def test_a_shared_id_links_nothing(spark):
    rows = [(1, text(0, [])), (1, text(1, [])), (2, text(1, [59])), (3, text(0, [0]))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()
    assert Counter(map(tuple, found)) == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)])
    assert brute(rows, 5, 80) == Counter([(1, 1), (1, 1), (2, 1), (3, 1)])


def test_toxicity_reads_one_text_of_a_repeated_id(spark):
    """9,000 rows of one id are one row of training, and the order of the table doesn't matter."""
    from pyspark.sql import functions as F

    from auditloom.llm import toxicity

    docs = [(1, f"a stupid text {i % 50}") for i in range(9000)] + [(i, f"a nice text about {i} birds") for i in range(2, 40)] + [
        (i, f"you stupid idiot {i}") for i in range(40, 60)
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1 or i >= 40)) for i in range(1, 60)] + [(1, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(frame, labels, F.lit(True)).collect()
    assert len(rows) == 59 and len({r["doc_id"] for r in rows}) == 59
    models = [toxicity.learn(frame.repartition(n), labels.repartition(n), F.lit(True)) for n in (1, 7)]
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias


def test_toxicity_ignores_held_out_labels(spark):
    """Labels of held-out rows turned round change no score."""
    from pyspark.sql import functions as F

    from auditloom.llm import toxicity
    from auditloom.llm.common import crc32_mod

    docs = spark.createDataFrame([(i, f"you stupid idiot {i}" if i % 3 == 0 else f"a bird sat on the mat {i}") for i in range(90)], "doc_id long, text string")
    held = crc32_mod("doc_id", 4) == 2
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert turned.subtract(labels).count() > 5
    scores = [sorted(map(tuple, toxicity.score(docs, toxicity.learn(docs, rows, ~held)).collect())) for rows in (labels, turned)]
    assert scores[0] == scores[1]
