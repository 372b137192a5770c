"""Periodic runs against a brute-force search."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from alertlake.llm import periodic, queries
from helpers import DOCS, LONG, awkward_docs, docs_frame, empty


def runs_by_hand(words):
    """Every period in turn: stretches in which words that far apart are identical."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start >= q and i + q - start >= 12:
                found.setdefault((start, i + q), q)
    return sorted((start, end - start, q) for (start, end), q in found.items())


def summary_by_hand(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    top = min(((-length, start, q) for start, length, q in runs), default=None)
    listed = "".join(f"{start},{length},{q}\n" for start, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def random_words(rng):
    """Texts of few words, of repeated blocks, and blocks within blocks."""
    size = rng.choice([1, 2, 3, 5, 50])
    words = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(4)):
        block = words[: rng.randrange(1, 40)] if words else ["x"]
        words = words[rng.randrange(len(words) + 1) :] + block * rng.randrange(1, 6) + block[: rng.randrange(len(block))] + words[:20]
    return words


@pytest.mark.parametrize("tile", [1, 3, 16, 2048])
def test_tiles_and_their_joins_equal_brute_force(tile, monkeypatch):
    monkeypatch.setattr(periodic, "TILE_WORDS", tile)
    rng = random.Random(tile)
    for _ in range(150):
        words = random_words(rng)
        found = []
        for octave, first, codes, boundaries in periodic.tiles_of(" ".join(words).encode()):
            found += periodic.solve(codes, first, octave, boundaries)
        whole = [(start, end - start, q) for q, start, end in periodic.joined(found) if end - start >= max(12, 2 * q)]
        assert sorted(whole) == runs_by_hand(words)


def test_query_equals_brute_force_on_random_and_awkward_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " \t".join(random_words(rng)), "en", "s", 1) for i in range(400)]
    rows += [(2**40 + i, rows[1][1], "en", "s", 1) for i in range(300)] + awkward_docs() + [(5, rows[2][1], "en", "s", 1), (11, "a b " * 9000, "en", "s", 1), (9013, LONG[:60_000] * 3, "en", "s", 1)]
    rows = [row for row in rows if row[1] is None or len(row[1].split()) < 20_000 or row[0] == 9013]
    folder = str(tmp_path)
    docs_frame(spark, rows).selectExpr("*", "'x' AS runs", "'x' AS doc", "1 AS salt").write.parquet(f"{folder}/documents.parquet")
    got = sorted((tuple(row) for row in queries.op13_periodic_runs(spark, folder).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        if doc_id == 9013:
            # Known by its making: too long for the brute force.
            assert sum(row[0] == 9013 and row[1] >= 1 for row in got) == 1
            continue
        want.append(summary_by_hand(doc_id, text))
    assert [row for row in got if row[0] != 9013] == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    empty(spark, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_periodic_runs(spark, str(tmp_path)).count() == 0


def test_a_loop_of_the_whole_text_is_one_run_and_one_period():
    words = [f"w{i}" for i in range(5000)]
    codes = np.array([hash(w) % 2**31 for w in words * 3], np.int32)
    assert periodic.next_repeat(codes).min() == 5000
    found = [interval for octave, first, part, at in periodic.tiles_of(" ".join(words * 3).encode()) for interval in periodic.solve(part, first, octave, at)]
    assert periodic.joined(found) == [(5000, 0, 15000)]
