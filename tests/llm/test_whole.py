"""Cases in which the operators once did less than the whole job."""

import random

import corpus_pipeline
import numpy as np
from alertlake.llm import html_text, minhash_dedup, packing, suffix_dedup
from alertlake.llm.shingles import shingle_set
from helpers import docs_frame
from test_dedup import removal_by_hand, union_find


def at_similarity(count, low, high, seed):
    """Pairs (id, text) of documents whose similarity lies within bounds."""
    rng, docs = random.Random(seed), []
    while len(docs) < 2 * count:
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(words)
        for _ in range(rng.randrange(2, 10)):
            other[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        a, b = (set(shingle_set(" ".join(x).encode()).tolist()) for x in (words, other))
        if low <= len(a & b) / len(a | b) < high:
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(other))]
    return docs


def linked(docs, percent):
    sets = {i: set(shingle_set(text.encode()).tolist()) for i, text in docs}
    return union_find([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])], sets)


def test_pipeline_takes_near_copies_from_four_fifths_on(spark):
    docs = at_similarity(60, 0.8, 0.85, 1) + [(1000 + i, text) for i, text in at_similarity(20, 0.74, 0.8, 2)]
    component = linked(docs, 80)
    want = {i for i in component if component[i] == i}
    assert len(want) == 100
    out = corpus_pipeline.near_copies(spark, docs_frame(spark, [(i, text, "en", "s", 1) for i, text in docs]), "")
    assert {row.doc_id for row in out.collect()} == want


def test_texts_of_a_repeated_id_are_one_document_and_none_is_lost(spark):
    """Ids with several texts: one component per id for the operator, one decision per text for the pipeline."""
    rng = random.Random(8)
    pairs = at_similarity(12, 0.9, 0.99, 6)
    rows = [(i, text) for i, text in pairs]
    rows += [(rng.choice([2, 3, 40, 41]), text) for _, text in rng.sample(pairs, 8)] + [(5, None), (6, ""), (5, pairs[0][1]), (50, pairs[7][1]), (50, "")]
    rows += [(60, at_similarity(1, 0.9, 0.99, 13)[0][1]), (60, at_similarity(1, 0.9, 0.99, 14)[0][1])]
    sets = [set(shingle_set((text or "").encode()).tolist()) for _, text in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union_find([(rows[a][0], rows[b][0]) for a, b in near], {i for i, _ in rows})
    frame = docs_frame(spark, [(i, text, "en", "s", 1) for i, text in rows])
    got = minhash_dedup.near_duplicates(frame).collect()
    assert len(got) == len(rows) and all(row.component_id == want[row.doc_id] for row in got)
    left = corpus_pipeline.near_copies(spark, frame, "").collect()
    texts = union_find([(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], range(len(rows)))
    place = {text: k for k, (_, text) in enumerate(rows)}
    assert sorted(texts[place[row.text]] for row in left if row.text) == sorted({texts[k] for k in range(len(rows)) if sets[k]})
    assert sum(not row.text for row in left) == 3


def test_long_text_after_an_empty_one_has_its_runs():
    rng = np.random.default_rng(3)
    long = rng.integers(97, 123, suffix_dedup.PIECE + 40_000, dtype=np.uint8).tobytes()
    hasher = suffix_dedup.Hasher(suffix_dedup.LENGTH)
    alone = hasher.all_runs([long])
    for texts, at in (([b"", long], 1), ([long, b"", b"", long], 3)):
        owner, *runs = hasher.all_runs(texts)
        assert [part[owner == at].tolist() for part in runs] == [part.tolist() for part in alone[1:]]


def test_long_text_after_a_null_loses_its_repeats(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    docs = [(1, None), (2, long), (3, ""), (4, long)]
    want = removal_by_hand(docs)
    frame = docs_frame(spark, [(i, text, "en", "s", 1) for i, text in docs]).coalesce(1)
    assert {row.doc_id: (row.n_bytes, row.n_removed) for row in suffix_dedup.removal_report(frame).collect()} == {i: want[i][:2] for i in want}


def test_near_copies_never_share_a_bin(spark):
    docs = at_similarity(30, 0.8, 0.99, 4)
    component = linked(docs, 80)
    rows = [(i, text, "en", f"s{i}", 1) for i, text in docs]
    # Without ids: a copy of the first text, and two near copies of each other. Blank texts are copies, nulls are not.
    (_, one), (_, two) = at_similarity(1, 0.85, 0.99, 9)
    rows += [(None, docs[0][1], "en", "n0", 1), (None, one, "en", "n1", 1), (None, two, "en", "n2", 1), (500, " ", "en", "b0", 1), (501, "", "en", "b1", 1), (502, None, "en", "b2", 1), (7, docs[7][1], "en", "again", 1)]
    sized = {row.source: row for row in packing.sized(docs_frame(spark, rows)).collect()}
    assert len(sized) == len(rows) and all(sized[f"s{i}"].cluster == str(component[i]) for i in component)
    assert sized["n0"].cluster == sized["s0"].cluster and sized["n0"].doc_id is None and sized["n0"].n_words == 200
    assert sized["n1"].cluster == sized["n2"].cluster != sized["n0"].cluster and sized["again"].cluster == sized["s7"].cluster
    assert sized["b0"].cluster == sized["b1"].cluster is not None and sized["b2"].cluster is None
    packed = packing.pack(packing.sized(docs_frame(spark, rows))).collect()
    kept = [(row.bin_group, row.bin, row.cluster) for row in packed if row.cluster]
    assert len(kept) == len(set(kept))


def test_extraction_keeps_the_whole_article():
    long = "many words of the article stand in here " * 20
    head = "<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav>"
    links = "<div class='more'>" + "<p><a href='/x'>another story of this site</a></p>" * 9 + "</div>"
    cases = [
        (f"<article><h1>Title</h1><p>lead</p><section><p>{long}</p></section><p>between</p><section class='b'><p>end</p></section></article>", ["Title", "lead", long.strip(), "between", "end"]),
        (f"<div class='post'><h1>Title</h1><ul><li>{long}</li><li>two</li></ul><p>after</p></div>", ["Title", long.strip(), "two", "after"]),
        (f"<div class='post'><p>intro</p><table><tr><th>key</th><td>{long}</td></tr></table></div>", ["intro", "key", long.strip()]),
    ]
    for body, want in cases:
        page = head + body + links + "</body></html>"
        best = next(iter(html_text.votes(page)))
        for path in (best, None):
            assert html_text.extract(page, path).split("\n") == want


def test_a_page_of_another_template_keeps_its_own_article(spark):
    page = "<html><body><div class='post'><p>{}</p></div><div class='{}'><p>{}</p></div></body></html>"
    long = "words of the article " * 20
    rows = [(i, "http://h/x", page.format(long, "box", "words of a box " * 5)) for i in range(6)]
    rows += [(8, "http://h/x", page.format("teaser", "report", long)), (9, "http://h/x", page.format("short", "box", long))]
    got = {row.page_id: row.text for row in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[8] == long.strip() == got[0] and got[9] == "short"
