"""Near-duplicate documents by MinHash.

Texts with the same set of shingles are one class from the start. Every class gets the minima of
many universal hash functions; ``ROWS`` minima at a time make a band, and classes that share a band
are candidates. Candidates are compared by signature and then on their full sets. Within a bucket
the pairs are never listed: first all members are held against one, then members of different
components meet in blocks of a fixed size. A block checks every such pair whose signature passes on
the full sets, in the first band that the pair shares, and returns a link only where it joins two
components, so no link between components is lost and the links grow with the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import utf8
from auditloom.llm.components import components
from auditloom.llm.words import WordHashes, mixed, runs
from auditloom.operators.lookup import lookup
from auditloom.operators.persisting import materialize

WIDTH = 5
MIN_PERCENT = 80
#: 40 bands of 5 minima: a pair at similarity 0.8 shares no band with probability 1.2e-7.
BANDS = 40
ROWS = 5
#: A signature is 200 minima of 8 bits; its estimate is off by 0.028 (one deviation) at 0.8.
SLACK = 0.14
MINOR_BLOCK = 256
OTHER_BLOCK = 1024

_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingles(text: bytes, width: int, memory: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, no words none."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = memory.of(words)
    return np.unique(runs(hashes, min(width, len(words))) + np.uint64(min(width, len(words))))


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function a * x + b over the shingles."""
    low = (mixed(found) >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), 1024):
            np.minimum(out, (low[i : i + 1024, None] * _A + _B).min(axis=0), out=out)
    return out


def _bands(values: np.ndarray) -> np.ndarray:
    parts = values.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return keys.view(np.int64)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash, bands, sketch of every row; no hash, bands or sketch without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            sizes, hashes, bands, sketches = [], [], [], []
            for text in utf8(batch.column("text")):
                found = shingles(text, width, memory)
                sizes.append(len(found))
                if not len(found):
                    for column in (hashes, bands, sketches):
                        column.append(None)
                    continue
                low = minima(found)
                hashes.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(_bands(low))
                sketches.append((low & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "set_hash", "bands", "sketch"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        sign, "doc_id long, text_hash long, n_shingles long, set_hash binary, bands array<bigint>, sketch binary"
    )


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) for the classes of ``wanted`` (rep, doc_id, text_hash), read from one text of each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            sets = [shingles(text, width, memory).view(np.int64) for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    met = texts.join(wanted.hint("merge"), ["doc_id", "text_hash"])
    # Rows that repeat id and text are together after the join: one of them is enough.
    one = met.groupBy("doc_id", "text_hash").agg(F.first("rep").alias("rep"), F.first("text").alias("text"))
    return one.select("rep", "text").mapInArrow(read, "rep long, shingles array<bigint>")


def _passing(pairs: DataFrame, reps: DataFrame, floor: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least ``floor`` of their places."""
    of_a = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("of_a"))
    of_b = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("of_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (_matrix(batch.column(name)) for name in ("of_a", "of_b"))
                enough = (one == other).mean(axis=1) >= floor
                yield batch.select(["a", "b"]).filter(pa.array(enough))

    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long")


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)


def confirmed(pairs: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough on their full sets."""
    of_a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a"))
    of_b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    met = pairs.join(of_a, "a").join(of_b, "b")
    return met.filter(100 * common >= min_percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def _blocks(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("int")


def crossing(members: DataFrame, reps: DataFrame, sets: DataFrame, home: DataFrame, min_percent: int) -> DataFrame:
    """(a, b): confirmed links that join components of one bucket; with ``home`` they span all of them.

    In a bucket every member outside the bucket's largest component meets all members, block by block.
    Members without a passing partner in their block go before the full sets are fetched.
    """
    placed = members.select("band", "rep").join(home.withColumnRenamed("node", "rep"), "rep", "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("component")
    )
    placed = materialize(placed, "placed")
    parts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    buckets = materialize(
        parts.groupBy("band").agg(
            F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("major"), F.count(F.lit(1)).alias("n_parts")
        ).filter(F.col("n_parts") > 1)
        .select(
            "band", F.col("major.component").alias("major"),
            _blocks(F.col("n") - F.col("major.n"), MINOR_BLOCK).alias("minor_blocks"),
            _blocks(F.col("n"), OTHER_BLOCK).alias("other_blocks"),
        ),
        "buckets",
    )
    met = placed.join(buckets, "band").join(reps.select("rep", "bands", "sketch"), "rep")
    spread = F.xxhash64("rep")
    facts = ["rep", "component", "bands", "sketch"]
    minor = met.filter(F.col("component") != F.col("major")).select(
        "band", F.pmod(spread, F.col("minor_blocks")).cast("int").alias("mine"),
        F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)).alias("other"), F.lit(True).alias("minor"), *facts,
    )
    others = met.select(
        "band", F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)).alias("mine"),
        F.pmod(spread, F.col("other_blocks")).cast("int").alias("other"), F.lit(False).alias("minor"), *facts,
    )
    keys = ["band", "mine", "other"]
    together = minor.unionByName(others).repartition(*keys).sortWithinPartitions(*keys)
    floor = min_percent / 100 - SLACK

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            block = _Block(rows)
            useful = np.zeros(len(block.rep), dtype=bool)
            for i in block.minors:
                partners = block.partners(i, floor)
                useful[partners] = True
                useful[i] |= len(partners) > 0
            if useful.any():
                yield from rows.filter(pa.array(useful)).to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            found = _Block(rows).links(rows.column("shingles").combine_chunks(), floor, min_percent)
            if found:
                yield pa.RecordBatch.from_pydict(
                    {"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())}
                )

    kinds = "band long, mine int, other int, minor boolean, rep long, component long, bands array<bigint>, sketch binary"
    sifted = materialize(together.mapInArrow(sift, kinds), "sifted")
    full = sifted.join(sets, "rep").repartition(*keys).sortWithinPartitions(*keys)
    return full.mapInArrow(link, "a long, b long").distinct()


class _Block:
    """Members of a bucket that meet: minors against the others."""

    def __init__(self, rows: pa.Table) -> None:
        minor = np.asarray(rows.column("minor").to_numpy(zero_copy_only=False), dtype=bool)
        self.minors, self.others = np.flatnonzero(minor), np.flatnonzero(~minor)
        self.rep, self.part = rows.column("rep").to_numpy(), rows.column("component").to_numpy()
        self.sketch = _matrix(rows.column("sketch").combine_chunks())
        self.bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.place = int(np.flatnonzero(self.bands[0] == rows.column("band")[0].as_py())[0]) if len(self.rep) else 0

    def partners(self, i: int, floor: float) -> np.ndarray:
        """Others in another component whose signature passes, and with whom this is the first band shared."""
        near = self.others[(self.part[self.others] != self.part[i]) & ~(self.bands[self.others, : self.place] == self.bands[i, : self.place]).any(axis=1)]
        return near[(self.sketch[near] == self.sketch[i]).mean(axis=1) >= floor] if len(near) else near

    def links(self, sets: pa.ListArray, floor: float, min_percent: int) -> list[tuple[int, int]]:
        values, starts = sets.values.to_numpy(), sets.offsets.to_numpy()
        sizes = np.diff(starts)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        out = []
        for i in self.minors:
            own = values[starts[i] : starts[i + 1]]
            own = np.sort(own)
            for j in self.partners(i, floor):
                mine, its = find(self.part[i]), find(self.part[j])
                if mine == its:
                    continue
                other = values[starts[j] : starts[j + 1]]
                at = np.searchsorted(own, other)
                at[at == len(own)] = 0
                common = int((own[at] == other).sum())
                if 100 * common >= min_percent * (sizes[i] + sizes[j] - common):
                    root[mine] = its
                    out.append((int(self.rep[i]), int(self.rep[j])))
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows with equal (band, mine, other), from batches sorted by them."""
    open_rows: list[pa.RecordBatch] = []
    open_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "mine", "other")], 1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for start, end in zip(edges, edges[1:], strict=False):
            key = tuple(keys[start])
            if open_rows and key != open_key:
                yield pa.Table.from_batches(open_rows)
                open_rows = []
            open_key = key
            open_rows.append(batch.slice(start, end - start))
    if open_rows:
        yield pa.Table.from_batches(open_rows)


def near_duplicates(docs: DataFrame, width: int = WIDTH, min_percent: int = MIN_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64) of every row of ``docs`` (doc_id, text).

    Documents whose shingle sets (A-Z lower-cased, ``width`` words, 64-bit hashes) share at least
    ``min_percent`` per cent of their union are linked; component_id is the smallest doc_id that links
    reach, and only that document is kept. A text with fewer words is one shingle; texts without words,
    and null, have none, are linked with nothing and kept. Rows without a doc_id are linked with
    nothing: component_id null, kept. Rows that repeat id and text are alike, and kept alike; rows that
    repeat an id with other texts are compared each, so one id may be in several components. Other columns are ignored.
    """
    signed = materialize(signatures(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), width), "signed")
    worded = signed.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    # A class goes by a hash of its set: ids can repeat with other texts.
    reps = materialize(
        worded.groupBy("set_hash").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
        ).select(F.xxhash64("set_hash").alias("rep"), "first", "bands", "sketch"),
        "reps",
    )
    bands = reps.select("rep", F.explode("bands").alias("band"))
    shared = materialize(
        bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub")).filter(F.col("n") > 1).drop("n"),
        "shared",
    )
    members = materialize(bands.join(shared, "band"), "members")
    wanted = members.select("rep").distinct().join(reps.select("rep", "first.doc_id", "first.text_hash"), "rep")
    sets = materialize(full_sets(docs, wanted, width), "sets")
    floor = min_percent / 100 - SLACK

    star = members.filter(F.col("rep") != F.col("hub")).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(confirmed(_passing(star, reps, floor), sets, min_percent), "links")
    home = materialize(components(links), "home")
    more = materialize(crossing(members, reps, sets, home, min_percent), "more")
    if not more.isEmpty():
        home = materialize(components(links.unionByName(more)), "home")
    placed = reps.select("rep", F.col("first.doc_id").alias("first")).join(home, F.col("rep") == F.col("node"), "left").select(
        "rep", "first", F.coalesce("component", "rep").alias("component")
    )
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(
        lookup(placed, smallest, "component").select(F.col("rep").alias("of_class"), "component_id"), "named"
    )
    empty = F.col("set_hash").isNull()  # these are in no class, and spread by their row
    found = signed.select(
        "doc_id", "text_hash", "n_shingles", empty.alias("empty"),
        F.when(empty, F.xxhash64("doc_id", "text_hash")).otherwise(F.xxhash64("set_hash")).alias("class"),
    )
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.join(named, (F.col("class") == F.col("of_class")) & ~F.col("empty"), "left").select(
        "doc_id", "n_shingles", linked.alias("component_id"),
        F.coalesce(F.col("doc_id") == linked, F.lit(True)).alias("kept"), "text_hash",
    )
