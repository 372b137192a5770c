import random

import corpus_pipeline
import pytest
from alertlake.llm import minhash_dedup, packing, suffix_dedup, warc
from helpers import awkward_docs, docs_frame, empty, rows_of
from pyspark.sql import functions as F


def naive_best_fit(pieces, capacity):
    """The tightest bin that has room and no conflict, by looking at all bins."""
    bins, chosen = [], []
    for size, source, cluster in pieces:
        fits = [(room, k) for k, (room, sources, clusters) in enumerate(bins) if room >= size and room > 0 and source not in sources and cluster not in clusters]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        bins[k][0] -= size
        bins[k][1] |= {source} - {None}
        bins[k][2] |= {cluster} - {None}
        chosen.append(k)
    return chosen


def test_best_fit_equals_brute_force():
    rng = random.Random(6)
    for _ in range(20):
        pieces = [(rng.randrange(0, 100), rng.choice("abcdefgh") if rng.random() < 0.9 else None, rng.choice([None, *range(30)])) for _ in range(150)]
        pieces.sort(key=lambda piece: -piece[0])
        assert packing.best_fit(pieces, 100) == naive_best_fit(pieces, 100)


def test_packing_loses_no_word_and_meets_all_conditions(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(0, 5000), rng.choice(["hot", "hot", f"s{i % 40}", None]), rng.choice([None, f"c{i % 50}"])) for i in range(3000)]
    frame = spark.createDataFrame(rows + [(None, None, None, None), rows[0], rows[0]], "doc_id bigint, n_words bigint, source string, cluster string").selectExpr("*", "1 AS bin")
    got = packing.pack(frame, group_rows=500).collect()
    assert sum(row.n_words for row in got) == sum(row[1] for row in rows) + 2 * rows[0][1] and len({row.bin_group for row in got}) == 7
    bins = {}
    for row in got:
        bins.setdefault((row.bin_group, row.bin), []).append(row)
    for members in bins.values():
        assert sum(row.n_words for row in members) <= packing.CAPACITY
        for name in ("source", "cluster"):
            named = [row[name] for row in members if row[name] is not None]
            assert len(named) == len(set(named))
    assert packing.pack(empty(spark, "doc_id bigint, n_words bigint, source string, cluster string")).count() == 0


def test_copies_share_a_cluster(spark):
    frame = spark.createDataFrame([("A b\tc",), (" a  B c\n",), ("a b d",), (None,)], "text string").select(packing.copy_cluster(F.col("text")).alias("c"), packing.word_count(F.col("text")).alias("n"))
    rows = rows_of(frame)
    assert rows[0][0] == rows[1][0] != rows[2][0] and rows[3] == (None, 0) and [row[1] for row in rows[:3]] == [3, 3, 3]


PAGES = "page_id bigint, url string, html string"


def pages(count):
    return [(i, f"http://h{i % 3}/p{i}", f"<p>page {i} é</p>" * (i % 5 + 1)) for i in range(count)]


def test_audit_finds_planted_damage(spark):
    rows = pages(900) + [(901, None, None), (None, "u", "x"), (7, "again", "same id"), (902, "big", "y" * 300_000)]
    bad = [row for row in rows if row[0] != 300]
    bad = [(i, url, html.replace("page", "Page", 1)) if i == 5 else (i, url, html + "!") if i == 700 else (i, url, html) for i, url, html in bad] + [(2000, "new", "n")]
    left, right = (warc.records(spark.createDataFrame(x, PAGES).selectExpr("*", "1 AS position", "2 AS digest")) for x in (rows, bad))
    report = warc.audit(warc.fixity_tree(left), warc.fixity_tree(right))
    assert {(row.page_id, row.fault) for row in report.collect()} == {(300, "missing"), (5, "altered"), (700, "resized"), (2000, "added")}
    assert warc.audit(warc.fixity_tree(left), warc.fixity_tree(left)).count() == 0
    assert warc.audit(*[warc.fixity_tree(warc.records(empty(spark, PAGES))) for _ in "ab"]).count() == 0


def test_warc_files_round_trip(spark, tmp_path):
    kept = warc.records(spark.createDataFrame(pages(40) + [(99, None, None)], PAGES))
    warc.write_warc(kept, str(tmp_path / "warc"))
    again = warc.read_warc(spark, str(tmp_path / "warc"))
    assert sorted(bytes(row.bytes) for row in again.collect()) == sorted(bytes(row.bytes) for row in kept.collect())
    assert sorted(row.page_id for row in again.select("page_id").collect()) == [*range(40), 99]
    with pytest.raises(Exception, match="version line"):
        warc.write_warc(warc.records(spark.createDataFrame([(1, "u", "WARC/1.0\r\nx")], PAGES)), str(tmp_path / "bad"))


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    count, texts = docs.count(), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns
        if name == "near copies":
            want = {row.doc_id for row in minhash_dedup.near_duplicates(docs, percent=minhash_dedup.NEAR_PERCENT).where("kept").collect()}
            assert {row.doc_id for row in out.collect()} == want
        if name == "repeated passages":
            texts = {row.doc_id: len(row.text.encode()) for row in out.collect()}
            report = {row.doc_id: row.n_bytes - row.n_removed for row in suffix_dedup.removal_report(docs).collect()}
            # Whole characters only, so a few bytes more may stay.
            assert texts.keys() == report.keys() and all(0 <= texts[i] - report[i] <= 400 for i in texts)
            assert out.where("n_chars <> length(text)").count() == 0
        else:
            assert out.count() < count
        docs, count = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    words = docs.select(F.sum(packing.word_count(F.col("text")))).first()[0]
    assert packed.agg(F.sum("n_words")).first()[0] == words
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_awkward_rows(spark):
    docs = docs_frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
        stage(spark, empty(spark, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "/root/testdata/sf0.001").count()
    assert corpus_pipeline.near_copies(spark, docs, "").count() == len(awkward_docs()) - 4
