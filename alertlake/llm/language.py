"""Language ID: nearest of several centroids per language over TF-IDF vectors of byte n-grams.

Whole texts become counts of two- and three-byte grams in ``SIZE`` hashed cells, weighted by inverse document frequency
over all learning documents, and scaled to length one. The centroids of a language are spherical k-means clusters of a
bounded sample of its documents (``SAMPLE_ROWS``). The nearest centroid by cosine gives the language; a cosine below the
least usual one of that language marks the row as rejected.

Defined results: a null text or one without a letter is ``und`` with score 0. Repeated rows get equal results; ids and
other columns are not read. An empty table gives an empty result; with nothing to learn from, all rows are ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.frames import add_columns, bounded_sample, text_bytes

SIZE = 8192
SAMPLE_ROWS = 1200  # per language
CENTROIDS = 4
UNKNOWN = "und"
# Bytes counted at a time, and documents whose vectors are held at a time.
PIECE, GROUP = 1 << 19, 128
# Learned languages that the driver plans samples for; more than this many is an error, not a cut.
MOST_LANGUAGES = 2000

# ASCII letters lower-cased, other ASCII to a space, the rest kept.
FOLD = bytes([b if b >= 128 else (b | 32 if chr(b).isalpha() else 32) for b in range(256)])
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "ignore"))))


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed grams, one row per text; long texts are counted piece by piece with the grams at the seams."""
    counts = np.zeros((len(texts), SIZE), dtype=np.float32)
    for row, text in enumerate(texts):
        folded = b" " + re.sub(rb" +", b" ", text.translate(FOLD)) + b" "
        for start in range(0, len(folded), PIECE):
            part = np.frombuffer(folded[start : start + PIECE + 2], np.uint8).astype(np.uint32)
            if len(part) > 1:
                pairs = part[:-1][:PIECE] * np.uint32(256) + part[1:][:PIECE]
                counts[row] += np.bincount(pairs * np.uint32(2654435769) >> np.uint32(19), minlength=SIZE)
            if len(part) > 2:
                triples = (part[:-2] * np.uint32(256) + part[1:-1]) * np.uint32(256) + part[2:]
                counts[row] += np.bincount((triples + np.uint32(1)) * np.uint32(2246822519) >> np.uint32(19), minlength=SIZE)
    return counts


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(gram_counts(texts)) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each cell occurs, over all of them; one small array per task reaches the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            texts = text_bytes(batch)
            rows += len(texts)
            for start in range(0, len(texts), GROUP):
                found += np.count_nonzero(gram_counts(texts[start : start + GROUP]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(SIZE), -1)), pa.array(np.append(found, rows))], names=["cell", "n"])

    added = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    values = dict(added.collect())  # SIZE + 1 rows
    return np.array([values.get(cell, 0) for cell in range(SIZE)]), values.get(-1, 0)


def clusters(rows: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each further one the row that the others fit worst."""
    centres = rows.mean(axis=0, keepdims=True)
    while len(centres) < min(count, len(rows)):
        worst = (rows @ (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).T).max(axis=1).argmin()
        centres = np.vstack([centres, rows[worst]])
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        nearest = (rows @ centres.T).argmax(axis=1)
        centres = np.stack([rows[nearest == k].mean(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Languages:
    names: list[str]
    owner: np.ndarray
    centres: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        names = [UNKNOWN] * len(texts)
        scores, rejected = np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        some = [i for i, text in enumerate(texts) if has_letter(text)] if self.names else []
        for start in range(0, len(some), GROUP):
            part = some[start : start + GROUP]
            cosine = vectors([texts[i] for i in part], self.idf) @ self.centres.T
            best = cosine.argmax(axis=1)
            for i, k, value in zip(part, best, cosine.max(axis=1), strict=True):
                names[i], scores[i] = self.names[self.owner[k]], min(max(float(value), 0.0), 1.0)
                rejected[i] = value < self.least[self.owner[k]]
        return names, scores, rejected


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, count: int = CENTROIDS) -> Languages:
    """Frequencies from all rows with a text and a language, centroids from at most ``rows`` documents of each language."""
    learn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = dict(learn.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect())
    names = list(sizes)
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    if not names:
        return Languages([], np.zeros(0, int), np.zeros((0, SIZE)), np.zeros(0), np.ones(SIZE))
    frequency, total = document_frequency(learn)
    idf = (np.log((1 + total) / (1 + frequency)) + 0.05).astype(np.float32)
    owner, centres, least = [], [], []
    for index, name in enumerate(names):
        sample = bounded_sample(learn.where(F.col("lang") == name).select("id", "text").where(F.octet_length("text") <= 1 << 16), rows, "id", sizes[name])
        texts = [text.encode() for text in sample.toPandas().sort_values("id")["text"]]
        own = vectors([text for text in texts if has_letter(text)] or [b"?"], idf)
        found = clusters(own, count)
        owner += [index] * len(found)
        centres.append(found)
        least.append(float(np.quantile((own @ found.T).max(axis=1), 0.002)) * 0.8)
    return Languages(names, np.array(owner), np.vstack(centres).astype(np.float32), np.array(least), idf)


def identify(docs: DataFrame, model: Languages, text_col: str = "text", reject: bool = False) -> DataFrame:
    """All columns of the documents, ``lang_pred``, ``score`` and ``rejected``; with ``reject`` such rows become ``und``."""

    def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        names, scores, rejected = model.predict(text_bytes(batch, text_col))
        if reject:
            names = [UNKNOWN if out else name for name, out in zip(names, rejected, strict=True)]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores), "rejected": pa.array(rejected)}

    return add_columns(docs, [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")], columns)
