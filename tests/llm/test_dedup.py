import random
from collections import defaultdict

import numpy as np
from alertlake.llm import embedding_dedup, minhash_dedup, setsketch, suffix_dedup
from alertlake.llm.cover_sort import equal_classes
from alertlake.llm.graph import components
from alertlake.llm.shingles import shingle_set
from helpers import LONG, PLAIN, awkward_docs, docs_frame, empty, rows_of


def union_find(pairs, nodes):
    parent = {node: node for node in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {node: find(node) for node in nodes}


def near_copies(count, seed):
    """Documents around a few templates, with edits of growing number: pairs on both sides of the threshold."""
    rng = random.Random(seed)
    templates = [[f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(6)]
    docs = []
    for i in range(count):
        words = list(rng.choice(templates))
        for _ in range(rng.randrange(5)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    return docs


def test_near_copies_equal_brute_force(spark):
    docs = near_copies(160, 3)
    sets = {i: set(shingle_set(text.encode()).tolist()) for i, text in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    unlinked = [(a, b) for a in sets for b in sets if a < b and 0.7 < len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.85]
    assert links and unlinked
    want = union_find(links, sets)
    got = minhash_dedup.near_duplicates(docs_frame(spark, [(i, text, "en", "s", 1) for i, text in docs]))
    assert {row.doc_id: row.component_id for row in got.collect()} == want


def test_near_copies_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE", 7)
    docs = [(i, text, "en", "s", 1) for i, text in near_copies(80, 5)]
    tiled = {row.doc_id: row.component_id for row in minhash_dedup.near_duplicates(docs_frame(spark, docs)).collect()}
    monkeypatch.undo()
    assert tiled == {row.doc_id: row.component_id for row in minhash_dedup.near_duplicates(docs_frame(spark, docs)).collect()}


def test_awkward_documents(spark):
    got = rows_of(minhash_dedup.near_duplicates(docs_frame(spark, clash=["kept", "print", "band"])))
    assert len(got) == len(awkward_docs())
    by_id = {row[0]: row[1:] for row in got}
    assert by_id[1][1:] == (1, True) and by_id[6][1:] == (1, False) and by_id[None][1:] == (None, True)
    assert by_id[2] == (0, 2, True) and by_id[3] == (0, 3, True) and by_id[4] == (0, 4, True)
    assert by_id[7] == (1, 7, True) and by_id[8] == (1, 7, False) and by_id[10][1:] == (5, False)
    assert rows_of(minhash_dedup.near_duplicates(empty(spark, "doc_id bigint, text string"))) == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:3000]
    one, two, both = setsketch.sketch_sets([a, b, pool])
    assert (np.maximum(one, two) == both).all()
    found = setsketch.estimate(one[None], two[None], np.array([2000]), np.array([2500]))
    assert abs(found[0] - 0.5) < 0.12
    big = setsketch.sketch_sets([rng.integers(0, 2**64, 2 * setsketch.BLOCK, dtype=np.uint64)])
    assert 0 < big.min() and big.max() < 255


def test_shingles_are_words_of_whole_texts(monkeypatch):
    from alertlake.llm import shingles

    text = b" A b\tc\x0bD e  f\n\xc3\x84 g"
    monkeypatch.setattr(shingles, "PIECE", 3)
    small = shingles.shingle_set(text)
    monkeypatch.undo()
    assert (small == shingles.shingle_set(b"a B c d E f \xc3\x84 g")).all() and len(small) == 4
    assert len(shingles.shingle_set(b"a b")) == 1 and len(shingles.shingle_set(b" \n")) == 0
    assert shingles.shingle_set(b"a b")[0] != shingles.shingle_set(b"b a")[0]


def removal_by_hand(docs, length=50):
    first = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], i)
    out = {}
    for i, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < i:
                gone[p : p + length] = True
        out[i] = (len(data), int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum()), bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def test_repeats_equal_brute_force(spark):
    import hashlib

    rng = random.Random(8)
    passages = ["".join(rng.choice("abcde fgé") for _ in range(rng.choice([40, 49, 50, 70, 200]))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("xyz ß") for _ in range(30)) for _ in range(rng.randrange(9)))) for i in range(120)]
    docs += [(200, "con, " * 60), (201, "con, " * 80), (202, None), (203, "")]
    # Longer than a piece, with an edit in the middle and another beginning.
    long = "".join(rng.choice("abcdefgh ") for _ in range(suffix_dedup.PIECE + 40_000))
    docs += [(210, long), (211, "start " + long[:150_000] + "EDIT" + long[150_000:])]
    want = removal_by_hand(docs)
    for row in suffix_dedup.removal_report(docs_frame(spark, [(i, text, "en", "s", 1) for i, text in docs])).collect():
        size, removed, spans, kept = want[row.doc_id]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (size, removed, spans, hashlib.sha256(kept).hexdigest())


def test_removed_text_keeps_whole_characters_and_columns(spark):
    got = suffix_dedup.remove_repeats(docs_frame(spark, clash=["_x", "marks"]))
    rows = {row.doc_id: row for row in got.collect()}
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_x", "marks"] and len(rows) == 11
    assert rows[1].text == PLAIN + "one" and rows[6].text == "" and rows[None].text == PLAIN + "one"
    assert rows[2].text is None and rows[3].text == "" and rows[5].text == LONG and rows[10].text == "" or len(rows[10].text) < 60
    assert rows_of(suffix_dedup.removal_report(empty(spark, "doc_id bigint, text string"))) == []


def test_cover_sort_finds_all_classes(monkeypatch):
    from alertlake.llm import cover_sort

    rng = random.Random(2)
    for alphabet in (b"ab", b"abcdef", b"a"):
        base = bytes(rng.choice(alphabet) for _ in range(400))
        text = base + base[10:] + b"zz" + base[5:200]
        monkeypatch.setattr(cover_sort, "BUCKET", rng.choice([64, 1 << 19]))
        suffixes = np.arange(len(text) - 49)
        got = set()
        for members, kinds in equal_classes(np.frombuffer(text, np.uint8), suffixes, 50):
            got |= {frozenset(members[kinds == k].tolist()) for k in np.unique(kinds)}
        want = defaultdict(list)
        for i in suffixes.tolist():
            want[text[i : i + 50]].append(i)
        assert got == {frozenset(places) for places in want.values() if len(places) > 1}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(rows_of(components(spark.createDataFrame(pairs, "a bigint, b bigint"))))
    want = union_find(pairs, {x for pair in pairs for x in pair})
    assert {node: got.get(node, node) for node in want} == want
    assert rows_of(components(empty(spark, "a bigint, b bigint"))) == []


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=32) for _ in range(150)]
    centre = rng.normal(size=32)
    rows += [centre + rng.normal(scale=0.05, size=32) for _ in range(40)]  # more links each than a list holds
    rows += [rows[3] * 2, rows[3] + 0.1, rows[160]]
    return [(i * 3, row.tolist()) for i, row in enumerate(rows)]


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rows = vectors(5)
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] * 32), (1004, [None] * 32), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (None, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + odd + [rows[0]], "vec_id bigint, embedding array<double>").selectExpr("*", "'x' AS links", "1 AS dim")
    x = np.array([row for _, row in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    ids = [i for i, _ in rows]
    want = union_find([(ids[a], ids[b]) for a, b in np.argwhere(near) if a < b], ids)
    got = embedding_dedup.near_duplicates(frame).collect()
    assert len(got) == len(rows) + 9 and len({row.vec_id for row in got}) == len(rows) + 8
    for row in got:
        if row.vec_id in want and row.vec_id != 0:
            assert (row.component_id, row.n_links) == (want[row.vec_id], near[ids.index(row.vec_id)].sum() - 1)
    by_id = {row.vec_id: row for row in got}
    assert by_id[0].n_links == 1 and all(by_id[i].n_links == 0 and by_id[i].kept for i in range(1000, 1005))
    assert by_id[1006].component_id == 1005 and not by_id[1006].kept
    assert by_id[1005].n_links == 2 and by_id[None].component_id == 1005 and by_id[None].n_links == 2 and not by_id[None].kept
    assert rows_of(embedding_dedup.near_duplicates(empty(spark, "vec_id bigint, embedding array<float>"))) == []


def test_isolated_pairs_near_the_threshold_are_all_found(spark):
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(6000, 48))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    cos = rng.uniform(0.9505, 0.96, 600)[:, None]
    side = rng.normal(size=(600, 48))
    side -= (side * rows[:600]).sum(axis=1, keepdims=True) * rows[:600]
    rows[600:1200] = cos * rows[:600] + np.sqrt(1 - cos**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    near = rows @ rows.T >= 0.95
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = {row.vec_id: row.n_links for row in embedding_dedup.near_duplicates(frame).collect()}
    assert got == {i: int(links) - 1 for i, links in enumerate(near.sum(axis=1))}


def test_tables_grow_with_the_vectors():
    space = embedding_dedup.Space(64, "<f8", 0.95)
    for count in (1, 100, 10**4, 10**6, 10**8, 10**10):
        bits, tables = space.tables(count)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= embedding_dedup.MISS * 1.01
        assert count / 2**bits <= 2 * embedding_dedup.CELL


def test_vectors_without_an_id_of_their_own(spark):
    a, b, c = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a), (5, c), (9, b), (None, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.05]), (7, [0.0, -1.0, 0.0]), (None, None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    found = sorted((tuple(row) for row in got), key=repr)
    assert found == sorted(
        [(5, 1, 5, True), (5, 0, 5, True), (9, 1, 5, False), (None, 1, None, True), (None, 1, None, True), (7, 0, 7, True), (None, 0, None, True)], key=repr
    )
