"""Periodic runs of words, found in tiles per octave of the period and stitched over tiles.

A run is a stretch of consecutive words whose smallest period is q, of at least ``LEAST_LENGTH`` words and two periods, that
no neighbouring word extends. For the periods of one octave, P to 2P - 1, every run holds a multiple b of P such that both b
and b + q lie in it. At such a boundary two Z-functions, one forward from b and one backward over what ends at b and b + q,
tell for each period of the octave how far it reaches; both look no further than 2P, so a boundary needs six octave widths
of words and nothing else of the document.

* ``tiles`` explodes every text into overlapping tiles, per octave. A boundary is left out only where no six words repeat
  within two octave widths: the six words at or just before a boundary of a run always do.
* ``solve`` works on one tile alone and joins what its boundaries have found; periods that are multiples of a smaller one
  are seen by the Z-function and left to the octave of the smaller.
* ``stitch`` shuffles by document and period and joins intervals that share at least one period of words. A long text's
  intervals are a few per tile, so a group is small against the text.

Equal texts are searched once, whatever their ids. Words of a text are compared as numbers that stand for the words
themselves, so there is no chance of a false match.

Defined results: a null or empty text, or one without a word, has no runs. Every row has the result of its own
text, also repeated rows, rows that share an id but not the text, and rows without an id. Ties for the longest run go to the
smaller start, then the smaller period. Empty tables give an empty result. Only the id and the text are read, so no other
column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.frames import id_text, stored, text_bytes
from alertlake.llm.shingles import pieces_of
from alertlake.plans.once import compute_once

LEAST_LENGTH = 12
# Boundaries of this many words share a tile, or of four octave widths where that is more.
TILE_WORDS = 2048
# A run of period q has at least max(12 - q, q) words that equal the word q later: six of them in a row.
GRAM = 6
NEVER = np.int64(1) << 40
# Copies of one text that have runs are spread over this many keys.
SALTS = 16
_RUN = pa.struct([(name, pa.int64()) for name in ("start", "period", "length")])
RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"
_PLACES = np.random.default_rng(20240607).integers(1, 2**63, GRAM, dtype=np.uint64) | np.uint64(1)

Interval = tuple[int, int, int]  # period, start, end


def z_function(s: list[int], count: int) -> list[int]:
    """Length of the longest common prefix of s and s[i:], for i below ``count``; 0 at i = 0."""
    z, n, left, right = [0] * count, len(s), 0, 0
    for i in range(1, count):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[i + k] == s[k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def smallest_prime_factors(q: int) -> list[int]:
    """The prime factors of a number."""
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] * (q > 1)


def at_boundary(codes: list[int], b: int, octave: int) -> Iterator[Interval]:
    """Intervals around boundary b with a smallest period in [octave, 2 * octave), up to two octave widths to both sides."""
    reach = 2 * octave
    ahead = codes[b : b + 2 * reach]
    forward = z_function(ahead, min(reach, len(ahead)))
    behind = codes[max(b - reach, 0) : b][::-1]
    # Backward from b + q for each q; -1 stands for no word and parts the two sides.
    low, high = max(b - octave, 0), min(b + reach, len(codes))
    joint = [*behind, -1, *codes[low:high][::-1]]
    first = len(behind) + 1 + high - b
    backward = z_function(joint, min(first, len(joint)))
    for q in range(octave, min(reach, high - b + 1)):
        back = backward[first - q] if first - q < len(backward) else 0
        fore = min(forward[q], reach) if q < len(forward) else 0
        if back + fore < q or any(q // p < len(forward) and forward[q // p] >= q - q // p for p in smallest_prime_factors(q)):
            continue
        yield q, b - back, b + q + fore


def joined(found: list[Interval]) -> list[Interval]:
    """Intervals of equal period that share at least a period of words are one interval."""
    out: list[Interval] = []
    for q, start, end in sorted(found):
        if out and out[-1][0] == q and start <= out[-1][2] - q:
            out[-1] = (q, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((q, start, end))
    return out


def solve(codes: np.ndarray, offset: int, octave: int, boundaries: np.ndarray) -> list[Interval]:
    """Intervals of one tile, in word numbers of the text; ``boundaries`` count from the first word of the tile."""
    words, found = codes.tolist(), []
    for b in boundaries.tolist():
        found += at_boundary(words, b, octave)
    return [(q, start + offset, end + offset) for q, start, end in joined(found)]


def words_of(text: bytes) -> Iterator[bytes]:
    """The words, a piece of the text at a time."""
    for piece in pieces_of(text):
        yield from piece.split()


def word_codes(text: bytes) -> np.ndarray:
    """A number for each word of the text, equal for equal words only."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(word, len(known)) for word in words_of(text)), np.int32)


def next_repeat(codes: np.ndarray) -> np.ndarray:
    """For each word, how many words later the six words that begin with it begin again; a huge number if never.

    Six words are compared by a hash: words taken for equal by mistake only make a boundary worth a look.
    """
    gap = np.full(len(codes), NEVER, np.int64)
    if len(codes) > GRAM:
        names = sum(codes[k : len(codes) - GRAM + 1 + k].astype(np.uint64) * place for k, place in enumerate(_PLACES))
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def tiles_of(text: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(octave, number of the first word, words, boundaries) of every tile of a text that may hold a run."""
    codes = word_codes(text)
    gap, octave = next_repeat(codes), 1
    while 2 * octave <= len(codes):
        near = np.flatnonzero(gap < 2 * octave)
        # A repeat at j makes the boundaries from j to j + 6 worth a look.
        marks = np.zeros(len(codes) + 1, np.int32)
        marks[near] += 1
        marks -= np.bincount(np.minimum(near + GRAM + 1, len(codes)), minlength=len(marks)).astype(np.int32)
        wanted = np.flatnonzero(np.cumsum(marks[:-1])[::octave] > 0) * octave
        width = max(TILE_WORDS, 4 * octave)
        for part in np.split(wanted, np.flatnonzero(np.diff(wanted // width)) + 1) if len(wanted) else ():
            first = max(int(part[0]) - 2 * octave, 0)
            yield octave, first, codes[first : int(part[-1]) + 4 * octave], (part - first).astype(np.int32)
        octave *= 2


def tiles(texts: DataFrame) -> DataFrame:
    """(doc, octave, first, words, boundaries) of (doc, text), words and boundaries as four-byte numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc"), text_bytes(batch), strict=True):
                for octave, first, words, boundaries in tiles_of(text):
                    yield pa.RecordBatch.from_pydict({"doc": pa.array([doc.as_py()], pa.binary()), "octave": pa.array([octave], pa.int64()), "first": pa.array([first], pa.int64()), "words": [words.astype(np.int32).tobytes()], "boundaries": [boundaries.tobytes()]})

    return texts.mapInArrow(run, "doc binary, octave bigint, first bigint, words binary, boundaries binary")


def solved(parts: DataFrame) -> DataFrame:
    """(doc, period, low, high) of the intervals that each tile holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, found = [], []
            for doc, octave, first, words, boundaries in zip(*(batch.column(name).to_pylist() for name in ("doc", "octave", "first", "words", "boundaries")), strict=True):
                intervals = solve(np.frombuffer(words, np.int32), first, octave, np.frombuffer(boundaries, np.int32))
                docs += [doc] * len(intervals)
                found += intervals
            columns = [pa.array([row[k] for row in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.binary()), *columns], names=["doc", "period", "low", "high"])

    return parts.mapInArrow(run, "doc binary, period bigint, low bigint, high bigint")


def stitch(intervals: DataFrame) -> DataFrame:
    """(doc, start, length, period) of the runs: intervals of one document and period joined where they share a period of words."""
    order = Window.partitionBy("doc", "period").orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = intervals.withColumn("fresh", F.coalesce((F.col("low") > reached - F.col("period")).cast("int"), F.lit(1)))
    islands = parted.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("doc", "period", "island").agg(F.min("low").alias("start"), F.max("high").alias("end"))
    length = F.col("end") - F.col("start")
    return whole.select("doc", "start", length.alias("length"), "period").where((F.col("length") >= LEAST_LENGTH) & (F.col("length") >= 2 * F.col("period")))


def find_runs(texts: DataFrame) -> DataFrame:
    """(doc, start, length, period) of all runs of (doc, text); equal texts must share the key ``doc``, a binary column."""
    # The tiles are dealt anew, so that those of one long text are solved by many tasks, and those of copies by one.
    return stitch(solved(tiles(texts).dropDuplicates(["doc", "octave", "first"])))


def repeats(text: bytes) -> bool:
    """Whether any six words of a text come again: without that it has no run."""
    return bool((next_repeat(word_codes(text)) < NEVER).any())


def looping_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, text, doc) of the texts that may hold runs; ``doc`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repeats(text) for text in text_bytes(batch)]
            kept = batch.filter(pa.array(found, pa.bool_()))
            docs = pa.array([hashlib.sha256(text).digest() for text in text_bytes(kept)], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept.columns, docs], names=["doc_id", "text", "doc"])

    return texts.mapInArrow(run, "doc_id bigint, text string, doc binary")


def plain_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of all other texts: no runs, and all of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if repeats(text) else b" ".join(words_of(text)) for text in text_bytes(batch)]
            kept = batch.filter(pa.array([text is not None for text in found], pa.bool_()))
            runs = pa.array([[]] * len(kept), pa.list_(_RUN))
            collapsed = pa.array([text for text in found if text is not None], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), runs, collapsed], names=["doc_id", "runs", "collapsed"])

    return texts.mapInArrow(run, f"doc_id bigint, runs {RUNS}, collapsed string")


def outside(text: bytes, runs: list[dict]) -> bytes:
    """Words outside of runs, and of each run those of its first period, joined by one space."""
    if not runs:
        return b" ".join(words_of(text))
    marks = np.zeros(max(r["start"] + r["length"] for r in runs) + 1, np.int64)
    for r in runs:
        marks[r["start"] + r["period"]] += 1
        marks[r["start"] + r["length"]] -= 1
    return b" ".join(compress(words_of(text), chain((np.cumsum(marks) == 0).tolist(), repeat(True))))


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's doc_id with ``runs``, (start, period, length) in that order, and ``collapsed``, its words without repetitions.

    Only texts that repeat any six words are stored, cut into tiles and joined with their runs, by text and salt: the copies
    of one text may be many, its runs are one row. All other texts stay where they are.
    """
    texts = id_text(docs, id_col, text_col)
    looping = stored(looping_texts(texts), "looping")
    # All runs of a text are fewer than its words, and go beside the text itself.
    per_text = find_runs(looping).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    salted = per_text.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    dealt = looping.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    found = dealt.join(salted, ["doc", "salt"], "left").select("doc_id", "text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            collapsed = [outside(text, runs) for text, runs in zip(text_bytes(batch), batch.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("runs"), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return found.mapInArrow(run, f"doc_id bigint, runs {RUNS}, collapsed string").union(plain_texts(texts))


def summary(collapsed: DataFrame) -> DataFrame:
    """Number of runs, the longest run, and digests of the runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    top = collapsed.withColumn("top", longest)
    return top.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / (-F.col("top.period"))).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in which the ends of some texts, chosen by a hash of the id, go round in a loop of words."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(code % 10 == 0, F.lit(False))
    # The words of a text that stays as it is are not sought; those of the others are, once.
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    rows = compute_once(id_text(docs, id_col, text_col), {"words": words, "g": F.floor(code / 10)})
    n, g = F.size("words"), F.col("g")
    rows = compute_once(rows, {"a": F.when(n > 0, g % n), "p": F.when(n > 0, 1 + F.floor((n - g % n) / (3 + g % 8)))})
    a, p = F.col("a"), F.col("p")
    turned = F.transform("words", lambda word, i: F.when(i < a, word).otherwise(F.get("words", (a + (i - a) % p).cast("int"))))
    return rows.select("doc_id", F.when(a.isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))
