"""Line-first cleaning of documents.

Every line is judged by punctuation, navigation and boilerplate rules; lines that fail are removed,
and a document that loses more than half of its words with them is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm.words import WordHashes, runs

TERMINAL = tuple(".!?…:;\"'”’»)]。！？")
SEPARATORS = "|›»•·>"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "lorem ipsum", "javascript", "cookie", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "click here", "subscribe to our newsletter", "sign up for", "log in to",
)
MAX_LOST = 0.5
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEATED_PERCENT = 30


def failed_rule(line: str, n_words: int) -> str | None:
    """Name of the rule that a line with words breaks, or None.

    punctuation: it neither ends as a sentence does nor holds a finished one, has a symbol for every fourth word, or an
    exclamation or question mark for every second word. navigation: items divided by separators.
    boilerplate: a stock phrase.
    """
    body = line.strip()
    if sum(map(body.count, SEPARATORS)) >= max(2, 0.2 * n_words):
        return "navigation"
    if not body.endswith(TERMINAL) and ". " not in body:
        return "punctuation"
    if 4 * sum(map(body.count, SYMBOLS)) >= max(4, n_words) or 2 * (body.count("!") + body.count("?")) > max(3, n_words):
        return "punctuation"
    lower = body.lower()
    return "boilerplate" if any(map(lower.__contains__, BOILERPLATE)) else None


def n_repeated(hashes: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words covered by windows that are found twice or more."""
    found = runs(hashes, window)
    if len(found) < 2:
        return 0
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(found), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str, memory: WordHashes) -> dict:
    words = text.encode().split()
    n_words = len(words)
    kept, seen = [], set()
    n_dup = lost = n_failed = 0
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            n_dup += line in seen
            seen.add(line)
            if failed_rule(line, n):
                lost += n
                n_failed += 1
                continue
        kept.append(line)
    repeated = n_repeated(memory.of(words))
    base_failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n_words
    return {
        "n_words": n_words,
        "word_chars": len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeated,
        "base_failed": base_failed,
        "kept": not base_failed and lost <= MAX_LOST * n_words,
        "n_failed_lines": n_failed,
        "n_lost_words": lost,
        "cleaned": "\n".join(kept),
    }


def clean(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): measures, verdict and, if wanted, the cleaned text.

    Null and empty texts have no words, fail the base rule and are not kept. Repeated rows are judged
    each by itself; other columns are ignored. Texts are read whole, a batch of rows at a time.
    """
    kinds = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "kept boolean, n_failed_lines long, n_lost_words long"
    )
    names = [kind.split()[0] for kind in kinds.split(", ")] + ["cleaned"] * with_text

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            rows = [measure(text.as_py() or "", memory) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([row[n] for row in rows], _arrow(n)) for n in names]],
                ["doc_id", *names],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        judged, f"doc_id {kind}, {kinds}" + ", cleaned string" * with_text
    )


def _arrow(name: str) -> pa.DataType:
    return {"base_failed": pa.bool_(), "kept": pa.bool_(), "cleaned": pa.string()}.get(name, pa.int64())
