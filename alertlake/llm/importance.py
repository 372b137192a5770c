"""Importance resampling towards a target distribution, by hashed n-grams.

A text is lower-cased (A-Z only) and every run of other ASCII characters than letters and digits becomes one space. An
overlapped scan of a pattern that begins at a space and covers up to three words, looking ahead to the next space, then
hands out the spans of the runs of 1 to 3 words that begin at each word; their bytes go straight into a running crc32, whose
remainder is the bucket. Counts of the buckets over the source and over the target give each bucket a gain, the sum of a
document's gains is its weight, and a fixed Gumbel noise per id makes the highest scores a draw without replacement in
proportion to the weights.

Bucket numbers of a document (two bytes per feature) are written once and read twice, to count and to weigh. The gains are
one number per bucket, whatever the corpus. The draw sorts (score, id) by ranges over the cluster and numbers each range
after the rows of those before it, so no task sees more than its range.

Defined results: a null or empty text, or one without a word, has no features and weight 0. A row without an id has no
noise: its score is null, it is never drawn and not counted among the documents to draw from. Every row is a document of its
own, so repeated rows are counted and drawn each; equal scores go to the smaller id, and between rows equal in both any order
gives the same result up to which of them bears which rank. Long texts are scanned in pieces, without a gap. Empty tables
give an empty result. Only the id and the text are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.frames import id_text, stored, text_bytes
from alertlake.llm.shingles import pieces_of

BUCKETS = 10_000
LEAST_WORDS, DRAWN_PERCENT, SEED = 20, 5, 42
# Rows of (score, id) that one task sorts.
RANGE_ROWS = 500_000

# Lower case, and a space for every other ASCII character than letters and digits.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GRAMS = regex.compile(rb" ([^ ]++)(?:( [^ ]++)(?:( [^ ]++))?)?(?= |$)")


def scan(line: bytes, buckets: array, final: bool) -> tuple[int, bytes]:
    """Append the buckets of all runs of words that begin in the line; before the last piece the last two words are handed on."""
    words = 0
    for match in _GRAMS.finditer(line, overlapped=True):
        one, two, three = match.groups()
        if three is None and not final:
            return words, line[match.start() :]
        words += 1
        code = zlib.crc32(one)
        buckets.append(code % BUCKETS)
        if two is not None:
            code = zlib.crc32(two, code)
            buckets.append(code % BUCKETS)
            if three is not None:
                buckets.append(zlib.crc32(three, code) % BUCKETS)
    return words, b""


def features(text: bytes) -> tuple[int, array]:
    """Number of words, and the bucket of every run of 1 to 3 words."""
    buckets, words, rest = array("H"), 0, b""
    for piece in pieces_of(text.translate(_FOLD)):
        found, rest = scan(b" " + b" ".join((rest + piece).split()), buckets, final=False)
        words += found
    return words + scan(rest, buckets, final=True)[0], buckets


def bucketed(texts: DataFrame) -> DataFrame:
    """(doc_id, n_words, buckets) of texts, the buckets as two-byte numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text) for text in text_bytes(batch)]
            columns = [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.large_binary()).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "buckets"])

    return texts.mapInArrow(run, "doc_id bigint, n_words bigint, buckets binary")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) over all rows; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(raw, np.uint16), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of every bucket in thousandths: the log ratio of its smoothed share of the target to that of the source."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for side, rows in enumerate((source, target)):
        # At most one row per bucket.
        for row in bucket_counts(rows).collect():
            counts[side, row.bucket] = row.n
    s_all, t_all = (int(total) for total in counts.sum(axis=1))
    ratio = [float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS)) for s, t in counts.T.tolist()]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """Gumbel noise of an id in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(rows: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of bucketed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(raw, np.uint16) for raw in batch.column("buckets").to_pylist()]
            weights = [int(gain[b].sum()) for b in found]
            scores = [None if i is None else w + noise(i, seed) for i, w in zip(batch.column("doc_id").to_pylist(), weights, strict=True)]
            columns = [batch.column("doc_id"), batch.column("n_words"), *(pa.array(v, pa.int64()) for v in ([len(b) for b in found], weights, scores))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def ranked(rows: DataFrame, count: int) -> DataFrame:
    """Rows of (score, doc_id, ...) with their place ``rank`` from 1 in the order of the draw, for any number of rows."""
    # Many rows of one id and text are equal in both; a number of their own lets ranges part them.
    order = [F.desc("score"), F.asc("doc_id"), F.asc("own")]
    numbered = rows.withColumn("own", F.xxhash64(F.monotonically_increasing_id()))
    ranges = stored(numbered.repartitionByRange(max(1, -(-count // RANGE_ROWS)), *order).withColumn("part", F.spark_partition_id()), "draw")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("size"))
    # One row per range; the sum over those before it gives each range its first place.
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = ranges.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    placed = inside.join(before.select("part", F.coalesce("before", F.lit(0)).alias("before")), "part")
    return placed.withColumn("rank", (F.col("before") + F.col("place")).cast("bigint")).drop("part", "place", "before", "own")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Every row's (doc_id, n_features, weight, score, rank): of the N documents with enough words, floor(percent * N / 100) are drawn."""
    source = stored(bucketed(id_text(docs, id_col, text_col)), "buckets")
    aim = bucketed(id_text(target.withColumn("_row", F.lit(0)), "_row", target_text_col))
    rows = stored(weighed(source, gains(source, aim), seed), "weights")
    open_ = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    count = rows.where(open_).count()
    drawn = ranked(rows.where(open_), count).withColumn("rank", F.when(F.col("rank") <= percent * count // 100, F.col("rank")))
    rest = rows.where(~open_).withColumn("rank", F.lit(None).cast("bigint"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*columns).unionByName(rest.select(*columns))
