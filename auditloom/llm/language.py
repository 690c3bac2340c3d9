"""Language identification by Bayesian evidence fusion.

The text gives a likelihood per language (character trigrams, learned from a bounded sample of
labelled rows). Declared markup language and address suffix give likelihoods learned by grouped
aggregation of the text posteriors over all rows, and the host gives a prior that is smoothed towards
its domain, and the domain's towards all rows. A row's own posterior is taken out of its host's and
domain's sums, so no row is its own evidence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import utf8
from auditloom.operators.persisting import materialize

#: Most labelled rows read for each language.
ROWS_PER_LANGUAGE = 1000
#: Leading bits of the hashes by which a label's texts are counted.
SAMPLE_BITS = 16
#: Bytes of sums that a task holds before it sends them on.
HELD = 32 << 20
#: Rows whose evidence is fused at a time.
ROWS = 2000
GRAM_BITS = 14
GRAMS = 1 << GRAM_BITS
#: Trigrams of one text overlap and depend on each other; so many count as one observation.
TRIGRAMS_PER_OBSERVATION = 6
PRIOR_WEIGHT = 10.0
MIN_CONFIDENCE = 0.5


def trigrams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text; digits, symbols and white space are one blank."""
    codes = np.frombuffer(b" " + text.lower() + b" ", dtype=np.uint8)
    letter = (codes >= 128) | ((codes >= 97) & (codes <= 122))
    codes = np.where(letter, codes, 32).astype(np.uint32)
    codes = codes[(codes != 32) | np.r_[True, codes[:-1] != 32]]
    if len(codes) < 3:
        return np.empty(0, dtype=np.uint32)
    joined = (codes[:-2] << np.uint32(16)) | (codes[1:-1] << np.uint32(8)) | codes[2:]
    return (joined * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)


def labelled_sample(docs: DataFrame, label: str, per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(label, text): at most ``per_language`` texts of each label, those with the smallest hashes.

    The hashes of a label are counted by their leading bits first, and only those up to the range that holds the last
    one wanted are put in order: one task sees the counts of a label and about ``per_language`` hashes, not its rows.
    """
    known = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select(
        F.col(label).alias("label"), "text", F.xxhash64("text").alias("h")
    )
    hashes = materialize(known.select("label", "h").distinct().withColumn("bin", F.shiftright("h", 64 - SAMPLE_BITS)), "label-hashes")
    before = F.sum("n").over(Window.partitionBy("label").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    counts = hashes.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    # One row per label; written, so that its size decides whether it is broadcast.
    ranges = materialize(counts.filter(F.col("before") < per_language).groupBy("label").agg(F.max("bin").alias("last_bin")), "last-ranges")
    first = Window.partitionBy("label").orderBy("h")
    near = hashes.join(ranges, "label").filter(F.col("bin") <= F.col("last_bin")).select("label", "h")
    placed = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_language)
    last = materialize(placed.groupBy("label").agg(F.max("h").alias("last")), "last-hashes")
    rows = known.join(last, "label").filter(F.col("h") <= F.col("last"))
    return rows.dropDuplicates(["label", "h"]).select("label", "text")


def trigram_model(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the smoothed log probability of every trigram in each.

    Every label is a language. Counts are summed by language and trigram before they reach the driver,
    where a language is one row of GRAMS numbers of four bytes, however many tasks counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), utf8(batch.column("text")), strict=True):
                counts = np.bincount(trigrams(text), minlength=GRAMS)
                totals[label] = totals.get(label, 0) + counts
        for label, counts in totals.items():
            found = np.union1d([0], np.flatnonzero(counts))  # a language without trigrams has a row as well
            yield pa.RecordBatch.from_pydict(
                {"label": [label] * len(found), "gram": pa.array(found, pa.int32()), "n": pa.array(counts[found], pa.int64())}
            )

    found = sample.mapInArrow(count, "label string, gram int, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, pairs in zip(batch.column("label").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                counts = np.full(GRAMS, 0.5)
                counts[[p["gram"] for p in pairs]] += [p["n"] for p in pairs]
                weights = np.log(counts / counts.sum()).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"label": [label], "weights": pa.array([weights.tobytes()], pa.binary())})

    pairs = found.groupBy("label").agg(F.collect_list(F.struct("gram", "n")).alias("pairs"))  # GRAMS of a label at most
    rows = pairs.mapInArrow(weigh, "label string, weights binary").toArrow().sort_by("label")
    if not rows.num_rows:
        return [], np.zeros((GRAMS, 0), dtype=np.float32)
    columns = [np.frombuffer(w.as_py(), np.float32) for w in rows.column("weights")]
    return rows.column("label").to_pylist(), np.ascontiguousarray(np.stack(columns, axis=1))


def text_likelihoods(docs: DataFrame, labels: Sequence[str], model: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, n_trigrams, the log likelihood of the whole text in every language, and its posterior by the
    text alone (zeros for a text without trigrams)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS numbers of four bytes a language
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            counts, values = [], []
            for text in utf8(batch.column("text")):
                grams = trigrams(text)
                found = np.bincount(grams, minlength=GRAMS) if len(grams) > GRAMS else None
                total = found @ table if found is not None else table[grams].sum(0)
                counts.append(len(grams))
                values.append(np.asarray(total, dtype=np.float64) / TRIGRAMS_PER_OBSERVATION)
            table_of = np.stack(values) if values else np.empty((0, len(labels)))
            posterior = _softmax(table_of) * (np.array(counts)[:, None] > 0) if values else table_of
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], pa.array(counts, pa.int64()), _lists(table_of), _lists(posterior)],
                [*keep, "n_trigrams", "loglik", "posterior"],
            )

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_trigrams long, loglik array<double>, posterior array<double>"
    return docs.select(*keep, "text").mapInArrow(score, schema)


def _softmax(values: np.ndarray) -> np.ndarray:
    raised = np.exp(values - values.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(kind, key, total): posterior mass of every language by each of ``keys`` and over all rows (kind "").

    One pass for all of them; a task sends a row per key it has seen, and what meets after the shuffle are single numbers.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            names = list(totals)
            values = pa.array(np.concatenate([totals[k] for k in names] or [np.empty(0)]), pa.float64())
            offsets = pa.array(np.arange(len(names) + 1) * n, pa.int32())
            totals.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in names], pa.string()), pa.array([v for _, v in names], pa.string()), pa.ListArray.from_arrays(offsets, values)],
                ["kind", "key", "sums"],
            )

        for batch in batches:
            mass = _matrix(batch.column("posterior"), n)
            for kind in ("", *keys):
                column = batch.column(kind).to_pylist() if kind else [""] * batch.num_rows
                places: dict[str, int] = {}
                rows_of = np.fromiter((places.setdefault(v, len(places)) for v in column), np.int64, batch.num_rows)
                found = np.zeros((len(places), n))
                np.add.at(found, rows_of, mass)
                for value, place in places.items():
                    totals[kind, value] = totals.get((kind, value), 0) + found[place]
            if len(totals) * n * 8 > HELD:
                yield out()
        yield out()

    parts = rows.select("posterior", *keys).mapInArrow(add, "kind string, key string, sums array<double>")
    single = parts.select("kind", "key", F.posexplode("sums").alias("place", "mass"))
    single = single.groupBy("kind", "key", "place").agg(F.sum("mass").alias("mass"))
    # A row per language at most.
    ordered = single.groupBy("kind", "key").agg(F.array_sort(F.collect_list(F.struct("place", "mass"))).alias("all"))
    return ordered.select("kind", "key", F.transform("all", lambda x: x["mass"]).alias("total"))


def _share(counts: np.ndarray, prior: np.ndarray, weight: float = PRIOR_WEIGHT) -> np.ndarray:
    """Shares of ``counts`` smoothed by ``weight`` rows of ``prior``."""
    return (counts + weight * prior) / (counts.sum(axis=1, keepdims=True) + weight)


def host_of(url: Column) -> Column:
    """Host of an address, lower case; an address without a scheme is a host itself."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][\w+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)$", 1)


def suffix_of(host: Column) -> Column:
    """Last label of a host that has more than one."""
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def declared_in(page: Column) -> Column:
    """Primary language that the markup of a page declares; empty without one."""
    return F.lower(F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))


def identify(
    rows: DataFrame,
    labels: Sequence[str],
    model: np.ndarray,
    keep: Sequence[str],
    allowed: Sequence[str] | None = None,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``keep`` columns, text_language, language, confidence and kept for every row.

    ``rows`` has the ``keep`` columns, text, __declared and __host (both strings, empty or null when
    unknown: no evidence). kept is false for a text without trigrams (null, empty, no letters), which
    has language null and confidence 0, for a confidence below ``min_confidence`` and for a language
    that isn't ``allowed``. Ties go to the language first by name. Repeated rows are evidence each.
    """
    n = len(labels)
    if n == 0:
        nothing = [F.lit(None).cast("string").alias(c) for c in ("text_language", "language")]
        return rows.select(*keep, *nothing, F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    scored = text_likelihoods(rows, labels, model, [*keep, "__declared", "__host"])
    host = F.coalesce("__host", F.lit(""))
    base = materialize(
        scored.select(
            *keep, "n_trigrams", "loglik", "posterior", F.coalesce("__declared", F.lit("")).alias("__declared"),
            host.alias("__host"), domain_of(host).alias("__domain"), suffix_of(host).alias("__suffix"),
        ),
        "likelihoods",
    )
    # One row per host, domain, suffix and declared language; written, so that both sides of a join
    # are plain shuffles and a frequent key is split.
    keys = {"__host": "of_host", "__domain": "of_domain", "__suffix": "of_suffix", "__declared": "of_declared"}
    sums = materialize(_sums(base, list(keys), n), "sums")
    met = base
    for key, total in keys.items():
        met = met.join(sums.filter(F.col("kind") == key).select(F.col("key").alias(key), F.col("total").alias(total)), key)
    everything = sums.filter(F.col("kind") == "").select(F.col("total").alias("of_all"))  # one row
    met = met.crossJoin(F.broadcast(everything))
    names = pa.array(labels, pa.string())

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            loglik, own = (_matrix(batch.column(c), n) for c in ("loglik", "posterior"))

            def others(column: str) -> np.ndarray:
                """Mass by the key without the row's own."""
                return np.maximum(_matrix(batch.column(column), n) - own, 0.0)

            def given(key: str) -> np.ndarray:
                return np.array([bool(v) for v in batch.column(key).to_pylist()])[:, None]

            prior_all = _share(others("of_all"), np.full((1, n), 1.0 / n))
            of_host = _share(others("of_host"), _share(others("of_domain"), prior_all))
            total = loglik + np.log(np.where(given("__host"), of_host, prior_all))
            for key, column in (("__declared", "of_declared"), ("__suffix", "of_suffix")):
                # log P(value | language) up to a constant: the value's share of the language's rows.
                total += np.where(given(key), np.log(_share(others(column), prior_all, 1.0) / prior_all), 0.0)
            fused = _softmax(total)
            known = batch.column("n_trigrams").to_numpy() > 0
            missing = pa.array(~known)
            by_text, language = (
                pa.compute.if_else(missing, pa.scalar(None, pa.string()), names.take(pa.array(table.argmax(axis=1)))) for table in (loglik, fused)
            )
            confidence = np.where(known, fused.max(axis=1), 0.0)
            fine = known & (confidence >= min_confidence)
            if allowed is not None:
                fine &= np.isin(np.array(labels)[fused.argmax(axis=1)], list(allowed))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], by_text, language, pa.array(confidence), pa.array(fine)],
                [*keep, "text_language", "language", "confidence", "kept"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text_language string, language string, confidence double, kept boolean"
    used = [*keep, "n_trigrams", "loglik", "posterior", *[k for k in keys if k not in keep], *keys.values(), "of_all"]
    return met.select(*used).mapInArrow(fuse, schema)
