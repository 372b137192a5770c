"""Quality rules: gradient-boosted trees over document statistics.

Every whole text is reduced to a row of statistics in one pass over Arrow batches, without a shuffle. The trees are
fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``) and score the rows as flat node arrays. Some statistics are
constrained: more symbols, repeats or duplicate lines can never raise a score.

Defined results: a null or empty text has no words, all counts 0, fails the base rules and is not kept. A null or
repeated id changes nothing, each row is scored by its text alone. An empty table gives an empty result. Further columns
pass through; one named like an output is replaced. Without labelled rows the base rules alone decide.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.frames import add_columns, bounded_sample, id_text, text_bytes
from alertlake.llm.gbt import Trees, fit_trees

SAMPLE_ROWS = 12_000
LEAST_WORDS = 50
KEEP_ABOVE = 0.5

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
CONTINUATION = bytes(range(0x80, 0xC0))
ONLY_SPACE = re.compile(rb"[\x20\x09-\x0D]*\Z")

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Statistic and the direction in which it may move the score.
FEATURES = {
    "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "mean_word": 0, "upper_share": -1, "digit_share": 0,
    "exclaim_per_word": -1, "pipe_per_word": -1, "distinct_share": 0, "log_words": 0, "line_words": 0, "stop_share": 0,
}


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in a three-word window which the text holds at least twice."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-2] * kinds + ids[1:-1]
    if kinds > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * kinds + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(windows) + 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """Base counts and features of one text. ``bytes.split`` cuts at the six ASCII white-space bytes exactly."""
    words = text.split()
    count = len(words)
    letters = b"".join(words)
    chars = len(letters) - (0 if letters.isascii() else len(letters) - len(letters.translate(None, CONTINUATION)))
    symbols = len(letters) - len(letters.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if not ONLY_SPACE.match(line)]
    dup_lines = len(lines) - len(set(lines))
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), dtype=np.int64, count=count)
    repeats = repeated_words(ids, max(len(numbers), 1))
    n, c = max(count, 1), max(len(letters), 1)
    short = int(np.bincount(ids, minlength=1).max()) if count else 0
    features = [
        symbols / n, dup_lines / max(len(lines), 1), repeats / n, chars / n, 1 - len(letters.translate(None, UPPER)) / c,
        1 - len(letters.translate(None, DIGITS)) / c, letters.count(b"!") / n, letters.count(b"|") / n, len(numbers) / n**0.8,
        np.log1p(count), count / max(len(lines), 1), short / n,
    ]
    return [count, chars, symbols, dup_lines, repeats], features


def describe(batch: pa.RecordBatch, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    counts, features = [], []
    for text in text_bytes(batch, text_col):
        a, b = statistics(text)
        counts.append(a)
        features.append(b)
    return np.array(counts, dtype=np.int64).reshape(-1, len(BASE)), np.array(features).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees for P(quality = 1), from at most ``rows`` labelled documents."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_quality")).where("_quality IN (0, 1)")
    chosen = bounded_sample(marked.groupBy("_id").agg(F.max("_quality").alias("_quality")), rows, "_id")
    matched = id_text(docs, id_col, text_col).join(chosen, F.col("doc_id") == F.col("_id"))
    # A repeated id counts once, so that the bound holds.
    joined = matched.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_quality").alias("_quality"))

    def features(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"features": pa.array(list(describe(batch)[1]), pa.list_(pa.float64()))}

    sample = add_columns(joined, [("features", "array<double>")], features).select("doc_id", "_quality", "features").orderBy("doc_id").toPandas()
    rows_ = np.array(sample["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_trees(rows_, sample["_quality"].to_numpy(dtype=float), np.array(list(FEATURES.values())))


def assess(docs: DataFrame, model: Trees, text_col: str = "text", keep_above: float = KEEP_ABOVE) -> DataFrame:
    """All columns of the documents, the base counts, ``base_failed``, ``rule_score`` and ``kept``."""
    learned = len(model.feature) > 1

    def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        counts, features = describe(batch, text_col)
        failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])
        score = model.probability(features) if learned else np.ones(len(features))
        added = {name: pa.array(counts[:, i]) for i, name in enumerate(BASE)}
        return added | {"base_failed": pa.array(failed), "rule_score": pa.array(score), "kept": pa.array(~failed & (score >= keep_above))}

    fields = [(name, "bigint") for name in BASE] + [("base_failed", "boolean"), ("rule_score", "double"), ("kept", "boolean")]
    return add_columns(docs, fields, columns)


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", keep_above: float = KEEP_ABOVE) -> DataFrame:
    """The documents that pass, with their own columns only."""

    def passing(batches):
        for batch in batches:
            counts, features = describe(batch, text_col)
            good = (counts[:, 0] >= LEAST_WORDS) & (100 * counts[:, 4] <= 50 * counts[:, 0])
            if len(model.feature) > 1:
                good &= model.probability(features) >= keep_above
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(passing, docs.schema)
