"""Personal data: base patterns as seeds, and bootstrapped contextual extraction of what they miss.

The base patterns find emails, addresses, card and phone numbers. Their matches are the seeds. Every match, and every other
token that is shaped like an identifier, is a slot; the words around a slot make lexical patterns (one or two words before
it, two after it, one on both sides), and patterns and instances form a bipartite graph. A pattern is as good as its slot is
pure: known instances that fill it, weighed by their scores, against all words of the corpus that stand in its place. Good
patterns make further instances known, with a score that combines the patterns they stand in; those again raise other
patterns, round by round, until a round finds nothing new. No number of rounds is set.

Spark scores the graph: edges are added up per pattern and instance before they are shuffled, so copies of a text weigh
nothing. Words that fill a pattern's place are counted over all texts; a bit map of fixed size, built from the patterns
that hold enough instances, keeps other places of the text from leaving the task, and the join afterwards is exact. Patterns
that could not reach the threshold if all of their instances were known are dropped before the rounds.

An identifier-shaped token becomes a span where a good pattern surrounds it, or where its instance, of ``LONG_ENOUGH`` letters and
digits at least, has become known elsewhere. It has the kind of the seeds that its patterns have in common. Base spans stay;
a found span never overlaps one.

Defined results: a null or empty text has no spans, and the digests are those of the empty text. Each row has the result of
its own text, whether its id is null or repeated; copies of a row count for one instance. Ties between kinds go to the one listed
first. Very long texts are searched whole, by patterns that take linear time. Empty tables give an empty result. Only the
id and the text are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.frames import id_text, stored
from alertlake.llm.shingles import mix, word_hashes

KINDS = ("email", "ip", "card", "phone")
# A pattern counts with this many different known instances, and from this purity on.
LEAST_INSTANCES, LEAST_PURITY = 5, 0.5
# Shortest identifier, in digits, and shortest that is told by itself wherever it stands.
LEAST_DIGITS, LONG_ENOUGH = 4, 8
# Bits of the map of patterns whose places are counted: 2 MB, at any size of the corpus.
MAP_BITS = 24

Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SHAPED = re.compile(r"(?<![A-Za-z0-9._%+@/#-])(?:\(?[0-9]++(?:[\x20().-]{1,2}[0-9]++)++(?![\w@])|[A-Za-z0-9._%+@/#-]*?[0-9@][A-Za-z0-9._%+@/#-]*+)")
_EDGES = "._%+@/#-("
# White space, quotes and brackets part the words of a context; A-Z are folded by the word hashes.
_PARTS = bytes(32 if chr(b) in "\x01\t\n\r\x0b\x0c\"'<>()[]{}" else b for b in range(256))
_SLOT = b"\x01"
_RNG = np.random.default_rng(20240611)
_WEIGHTS = _RNG.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_START, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part of any length, an at sign, and a domain with a dot: sought from the sign, for a long word costs no more."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        stop = at + 1
        if domain and at > free:
            start = at
            while start > free and _LOCAL.match(text, start - 1, start):
                start -= 1
            if start < at:
                free = stop = domain.end()
                yield start, free
        # What precedes this sign cannot belong to a later one.
        free, at = max(free, at + 1), text.find("@", stop)


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind as listed and then start; leftmost, a match that fails its test is dropped."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", start, end) for start, end in emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


def slots(text: str, base: list[Span]) -> list[tuple[str | None, int, int]]:
    """Base matches and identifier-shaped tokens beside them, without overlap, by start; kind is None where no base pattern matches."""
    taken: list[tuple[str | None, int, int]] = []
    free = -1
    for kind, start, end in sorted(base, key=lambda s: (s[1], KINDS.index(s[0]))):
        if start >= free:
            taken.append((kind, start, end))
            free = end
    at, shaped = 0, []
    for m in _SHAPED.finditer(text):
        start, end = m.span()
        while start < end and text[start] in _EDGES and not (text[start] == "+" and text[start + 1 : start + 2].isdigit()):
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        while at < len(taken) and taken[at][2] <= start:
            at += 1
        token = text[start:end]
        if (at == len(taken) or taken[at][1] >= end) and ("@" in token or sum(map(token.count, "0123456789")) >= LEAST_DIGITS):
            shaped.append((None, start, end))
    return sorted(taken + shaped, key=lambda s: s[1])


def instance_text(token: str) -> str:
    """What stays the same when an identifier is written another way."""
    return re.sub(r"[^a-z0-9@]+", "", token.lower())


def code_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def context_keys(text: str, places: list[tuple[str | None, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the four patterns at every word of a text, a slot being one word, and the word numbers of the slots."""
    if places:
        parts, at = [], 0
        for _, start, end in places:
            parts += [text[at:start].encode().translate(_PARTS), _SLOT]
            at = end
        raw = b" ".join([*parts, text[at:].encode().translate(_PARTS)])
    else:
        raw = text.encode().translate(_PARTS)
    words = word_hashes(raw)
    padded = np.concatenate([[_START, _START], words, [_END, _END]]).astype(np.uint64)
    n, w = len(words), _WEIGHTS
    before2, before, after, after2 = padded[:n], padded[1 : n + 1], padded[3 : n + 3], padded[4 : n + 4]
    keys = np.stack([mix(before * w[0]), mix(before2 * w[1] + before * w[2]), mix(before * w[3] + after * w[4]), mix(after * w[5] + after2 * w[6])]).view(np.int64)
    return keys, np.flatnonzero(words == _SLOT_HASH) if places else np.zeros(0, np.int64)


_SLOT_HASH = word_hashes(_SLOT)[0]

_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SLOTS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("size", pa.int32()), ("patterns", pa.list_(pa.int64()))]))
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
MENTIONS = f"doc_id bigint, base {SPANS}, slots array<struct<kind:string,start:bigint,end:bigint,instance:bigint,size:int,patterns:array<bigint>>>"


def mentions_of(text: str) -> tuple[list[Span], list[tuple]]:
    base = base_spans(text)
    places = slots(text, base)
    if not places:
        return base, []
    keys, at = context_keys(text, places)
    noted = []
    for (kind, start, end), patterns in zip(places, keys[:, at].T.tolist(), strict=True):
        name = instance_text(text[start:end])
        noted.append((kind, start, end, code_of(name), len(name), patterns))
    return base, noted


def mentions(texts: DataFrame) -> DataFrame:
    """(doc_id, base, slots) of every row: base spans, and slots with their instance and the keys of the patterns around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mentions_of(text or "") for text in batch.column("text").to_pylist()]
            base = pa.array([[dict(zip(("kind", "start", "end"), span, strict=True)) for span in spans] for spans, _ in found], _SPANS)
            names = ("kind", "start", "end", "instance", "size", "patterns")
            places = pa.array([[dict(zip(names, slot, strict=True)) for slot in noted] for _, noted in found], _SLOTS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), base, places], names=["doc_id", "base", "slots"])

    return texts.mapInArrow(run, MENTIONS)


def pattern_map(patterns: DataFrame) -> np.ndarray:
    """Bit map of the low bits of the keys: a number of rows that is fixed by its size comes to the driver."""
    place = F.col("pattern").bitwiseAND((1 << MAP_BITS) - 1) + 1
    rows = patterns.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    found = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in rows:
        bits = np.frombuffer(row.bits, np.uint8)
        found[(row.bucket - 1) * len(bits) : row.bucket * len(bits)] = bits
    return found


def fills(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, fills): how many words of all texts stand in the place of each of the patterns."""
    wanted, low = pattern_map(patterns), np.int64((1 << MAP_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = []
            for text in batch.column("text").to_pylist():
                if text:
                    keys = context_keys(text, slots(text, base_spans(text)))[0].ravel()
                    place = keys & low
                    passed.append(keys[(wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1])
            keys, counts = np.unique(np.concatenate(passed), return_counts=True) if passed else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["pattern", "fills"])

    counted = texts.select("text").mapInArrow(run, "pattern bigint, fills bigint").groupBy("pattern").agg(F.sum("fills").alias("fills"))
    return counted.join(patterns.select("pattern"), "pattern")


def kind_order(kind: str = "kind"):
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))


def graph(texts: DataFrame, noted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (pattern, instance, n, fills) of patterns that can become good, and the seeds (instance, kind)."""
    places = noted.select(F.inline("slots")).drop("start", "end", "size")
    edges = stored(places.withColumn("pattern", F.explode("patterns")).groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.min(kind_order()).alias("rank")), "edges")
    wide = stored(edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("most")).where(F.col("instances") >= LEAST_INSTANCES), "patterns")
    pure = fills(texts, wide).join(wide, "pattern").where(F.col("most") >= LEAST_PURITY * (F.col("fills") + 1))
    seeds = edges.where("rank > 0").groupBy("instance").agg(F.min("rank").alias("rank"))
    kept = stored(edges.join(pure.select("pattern", "fills"), "pattern").drop("rank"), "graph")
    named = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank").cast("int"))
    # Seeds that no remaining pattern touches have no part in the rounds.
    return kept, seeds.join(kept.select("instance").distinct(), "instance").select("instance", named.alias("kind"))


def good_patterns(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, kind, purity) of patterns whose places known instances of one kind fill."""
    held = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.count("*").alias("instances"), F.max("fills").alias("fills"))
    purity = F.col("hits") / (F.col("fills") + 1)
    return held.where(F.col("instances") >= LEAST_INSTANCES).select("pattern", "kind", purity.alias("purity")).where(F.col("purity") >= LEAST_PURITY)


def best_kind(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """One row per key: the kind with the best score, the first listed of equal ones."""
    best = F.max(F.struct(F.col(score).alias(score), (-kind_order()).alias("place"), F.col("kind").alias("kind"))).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, "best.kind", F.col(f"best.{score}").alias(score))


def bootstrap(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known instances (instance, kind, score, seed) and good patterns (pattern, kind, purity) when a round finds nothing new."""
    known = stored(seeds.withColumns({"score": F.lit(1.0), "seed": F.lit(True)}), "known")
    while True:
        patterns = stored(good_patterns(edges, known), "good")
        # The chance that not all of its patterns are wrong about it; a score stays as it was when found.
        chance = (1 - F.exp(F.sum(F.log(1 - F.col("purity"))))).alias("score")
        reached = edges.join(patterns, "pattern").join(known.select("instance"), "instance", "left_anti")
        fresh = stored(best_kind(reached.groupBy("instance", "kind").agg(chance), ["instance"], "score").withColumn("seed", F.lit(False)), "fresh")
        if fresh.isEmpty():
            return known, patterns
        known = stored(known.unionByName(fresh), "known")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's (doc_id, base, found): base spans, and spans that the context gives away, each with kind, start and end."""
    texts = id_text(docs, id_col, text_col)
    noted = stored(mentions(texts).withColumn("row", F.monotonically_increasing_id()), "mentions")
    known, patterns = bootstrap(*graph(texts, noted))
    open_ = noted.select("row", F.inline("slots")).where("kind IS NULL").drop("kind")
    around = open_.withColumn("pattern", F.explode("patterns")).join(patterns, "pattern").select("row", "start", "end", "kind", F.col("purity").alias("score"))
    told = open_.where(F.col("size") >= LONG_ENOUGH).join(known.where("NOT seed"), "instance").select("row", "start", "end", "kind", "score")
    spans = best_kind(around.union(told), ["row", "start", "end"], "score")
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    return noted.join(per_row, "row", "left").select("doc_id", "base", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def report(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans as text, by kind as listed and then start."""

    def listed(spans):
        order = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "found")).alias("spans"))
