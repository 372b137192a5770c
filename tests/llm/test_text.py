import math
import os

import numpy as np
import pytest
from alertlake.llm import cnn, html_text, language, pieces, quality_rules
from alertlake.llm import queries as llm_queries
from alertlake.llm.gbt import fit_trees
from helpers import LONG, PLAIN, awkward_docs, docs_frame, empty, rows_of

SF = os.environ.get("ALERTLAKE_SF_DIR", "/root/testdata/sf0.01")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# ---- quality rules


def base_by_hand(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, window in enumerate(windows) if windows.count(window) > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    return [len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)]


def test_base_counts_equal_brute_force():
    texts = ["", "a", "a b c a b c", "a b c\x0bd\n\na b c\r\n \na b c", "é#é |x| <b>", "x " * 9, "a b a b a b c", "u v w x"]
    for text in texts:
        assert quality_rules.statistics(text.encode())[0] == base_by_hand(text), text
    for i in range(0, len(awkward_docs())):
        text = awkward_docs()[i][1]
        if text is None or len(text) < 10_000:
            assert quality_rules.statistics((text or "").encode())[0] == base_by_hand(text)


def test_trees_respect_directions():
    rng = np.random.default_rng(0)
    rows = rng.random((800, 3))
    target = (rows[:, 0] + rng.normal(scale=0.4, size=800) < 0.5).astype(float)
    trees = fit_trees(rows, target, np.array([-1, 1, 0]))
    for feature, sign in ((0, -1), (1, 1)):
        line = np.tile(rng.random(3), (200, 1))
        line[:, feature] = np.linspace(-0.5, 1.5, 200)
        assert (sign * np.diff(trees.margin(line)) >= -1e-12).all()
    assert ((trees.probability(rows) > 0.5) == (target > 0)).mean() > 0.75


def test_rules_take_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = docs_frame(spark, clash=["kept", "N_WORDS", "features"])
    got = quality_rules.assess(docs, quality_rules.fit(docs, labels)).collect()
    assert len(got) == len(awkward_docs())
    by_id = {row.doc_id: row for row in got}
    assert by_id[2].n_words == 0 and by_id[2].base_failed and not by_id[2].kept and by_id[5].n_words == 80_000
    assert by_id[1].n_repeat_words > 80 and by_id[1].base_failed
    none = quality_rules.fit(docs, empty(spark, "doc_id bigint, quality int, toxic int"))
    assert quality_rules.assess(empty(spark, "doc_id bigint, text string"), none).count() == 0
    assert quality_rules.keep_good(docs, none).columns == docs.columns


# ---- held-out accuracy of the learned operators


@pytest.mark.parametrize("name, least", [("op9_quality_classifier", 0.93), ("op6_quality_rules", 0.97), ("op7_language_id", 0.97)])
def test_held_out_accuracy(spark, name, least):
    got = llm_queries.all_queries()[name](spark, SF)
    if name == "op7_language_id":
        truth = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "lang AS truth")
        right = got.where("held_out").join(truth, "doc_id").selectExpr("lang_pred = truth AS right")
    else:
        verdict = "predicted = quality" if name.startswith("op9") else "kept = (quality = 1)"
        only = "held_out" if name.startswith("op9") else "NOT base_failed AND crc32(CAST(doc_id AS STRING)) % 4 = 2"
        right = got.where(only).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").selectExpr(f"{verdict} AS right")
    marks = [row.right for row in right.collect()]
    assert len(marks) > 20 and sum(marks) / len(marks) >= least


# ---- byte network


def test_folded_tables_equal_the_layers():
    net = cnn.new_network(3)
    rng = np.random.default_rng(2)
    net.filter_bias[:] = rng.normal(size=cnn.FILTERS)
    texts = [b"", b"x", bytes(rng.integers(0, 256, 255, dtype=np.uint8)), bytes(rng.integers(0, 256, 1500, dtype=np.uint8))]
    want = []
    for text in map(cnn.padded, texts):
        chunks = []
        for k in range(cnn.chunks_of(text)):
            part = net.embed[text[k * cnn.STEP : k * cnn.STEP + cnn.CHUNK + cnn.WIDTH - 1]]
            rows = np.stack([part[i : i + cnn.WIDTH].ravel() for i in range(cnn.CHUNK)])
            chunks.append(np.maximum(np.maximum(rows @ net.filters + net.filter_bias, 0).max(0) @ net.hidden + net.hidden_bias, 0))
        both = np.concatenate([np.max(chunks, 0), np.mean(chunks, 0)])
        want.append(1 / (1 + np.exp(-(both @ net.out + net.out_bias[0]))))
    assert np.allclose(cnn.Scorer(net).score(texts), want, atol=1e-4)


def test_slopes_equal_differences():
    net = cnn.new_network(4)
    data, target, weight = [cnn.padded(b"abc def" * 70), cnn.padded(b"zz")], np.array([1.0, 0.0], np.float32), np.ones(2, np.float32)

    def loss():
        p = np.clip(cnn.Scorer(net).score([b"abc def" * 70, b"zz"]), 1e-7, 1 - 1e-7)
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    slopes = cnn.gradient(net, data, target, weight)
    for part, slope in ((net.out, slopes[5]), (net.hidden, slopes[3]), (net.filters, slopes[1])):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        before = part[at]
        part[at] = before + 1e-2
        high = loss()
        part[at] = before - 1e-2
        low = loss()
        part[at] = before
        assert abs((high - low) / 2e-2 - slope[at]) < 0.05 * abs(slope[at]) + 2e-3


def test_network_takes_awkward_rows(spark):
    docs = docs_frame(spark, clash=["score", "PREDICTED"])
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    net = cnn.train(docs, labels)
    got = cnn.classify(docs, net).collect()
    assert len(got) == len(awkward_docs()) and all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7) for row in got)
    assert cnn.classify(empty(spark, "doc_id bigint, text string"), net).count() == 0
    untaught = cnn.train(docs, empty(spark, "doc_id bigint, quality int, toxic int"))
    assert {row.score for row in cnn.classify(docs, untaught).collect()} == {0.5}


# ---- language


def test_language_takes_awkward_rows(spark):
    docs = docs_frame(spark, clash=["lang_pred", "rejected", "id"])
    model = language.train(docs)
    by_id = {row.doc_id: row for row in language.identify(docs, model).collect()}
    assert {by_id[i].lang_pred for i in (2, 3, 4)} == {"und"} and by_id[1].lang_pred == "en" and by_id[9].lang_pred == "de"
    assert all(0 <= row.score <= 1 for row in by_id.values())
    nothing = language.train(empty(spark, "doc_id bigint, text string, lang string"))
    assert {row.lang_pred for row in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(empty(spark, "doc_id bigint, text string"), model).count() == 0
    far = language.identify(docs_frame(spark, [(1, "qqzzxx jjqq vvkk", "en", "a", 1)]), model, reject=True).first()
    assert far.lang_pred == "und" and far.rejected


def test_gram_counts_do_not_depend_on_pieces(monkeypatch):
    whole = language.gram_counts([LONG.encode(), b""])
    monkeypatch.setattr(language, "PIECE", 1000)
    assert (language.gram_counts([LONG.encode(), b""]) == whole).all()


# ---- html


def test_extraction(spark):
    page = (
        '<html><head><title>t</title><style>p{}</style><script>x="<p>no</p>"</script></head><body class="has-sidebar with-comments"><nav><ul><li><a href="/a">menu</a></li></ul></nav>'
        '<div class="ad">buy now</div><article id=1><h1>Head&amp;line</h1><p><b>One  two.<br><p>Three &lt;four&gt;\n five</p><!-- c --><form><p>sign up</p></form><button>go</button><div style="display: none"><p>unseen</p></div>'
        '<div class="comments"><p>first!</p></div><div><p>inner text</p></div></article><footer>&copy; us</footer>'
    )
    text = "Head&line\nOne two.\nThree <four> five\ninner text"
    rows = [(1, "http://h.example/a", page), (2, "http://h.example/b", page + "</body><"), (3, None, None), (4, "odd", ""), (5, "http://h.example/c", "<p>only &amp; this &am"), (None, None, page), (1, "http://h.example/a", page)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "'y' AS path", "1 AS host")
    got = {(row.page_id, row.url): (row.text, row.n_chars) for row in html_text.extract_text(frame).collect()}
    assert got[1, "http://h.example/a"] == (text, len(text)) == got[2, "http://h.example/b"] == got[None, None]
    assert got[3, None] == ("", 0) == got[4, "odd"] and got[5, "http://h.example/c"][0] == "only & this &am"
    assert html_text.extract_text(empty(spark, "page_id bigint, url string, html string")).count() == 0


def test_votes_of_a_host_win(spark):
    body = "<html><body><div class='post-12'><p>{}</p></div><div class='box'><p>{}</p></div></body></html>"
    rows = [(i, "http://h/x", body.format("article text " * 20, "other words " * 3)) for i in range(5)] + [(9, "http://h/x", body.format("short", "a longer boilerplate box " * 9))]
    got = {row.page_id: row.text for row in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "short"


# ---- pieces


def test_encoding_equals_the_library_with_the_unigram_rule(tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=MODEL).serialized_model_proto())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for piece in model.pieces:
        piece.score = -math.log(2 - piece.score) if piece.type == 1 else piece.score
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["Hello  world\nfoo é 漢", "a", " lead and trail ", PLAIN[:300], "\tx  \n\n y 😀", "internationalization of the thing", "é", "();\r\n"]
    encoder = pieces.Encoder(pieces.read_vocabulary(MODEL))
    assert pieces.Encoder(pieces.read_vocabulary(str(path))).encode(texts) == encoder.encode(texts)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == library.encode(text), text
    assert encoder.encode(texts) == pieces.Encoder(encoder.vocabulary).encode(texts)


def test_segmentation_equals_brute_force():
    vocabulary = pieces.Vocabulary({" ": (1, -3.0), "a": (2, -2.0), "ab": (3, -2.5), " a": (4, -4.0), "b": (5, -2.2), "bab": (6, -3.9)}, [b"?", b" ", b"a", b"ab", b" a", b"b", b"bab"], [], 0, -20.0, 3)

    def best(word):
        ways = [(0.0, ())] + [None] * len(word)
        for end in range(1, len(word) + 1):
            options = [(ways[s][0] + vocabulary.pieces[word[s:end]][1], ways[s][1] + (vocabulary.pieces[word[s:end]][0],)) for s in range(end) if word[s:end] in vocabulary.pieces]
            if word[end - 1] not in vocabulary.pieces:
                options.append((ways[end - 1][0] - 20, ways[end - 1][1] + (0,)))
            ways[end] = max(options, key=lambda way: way[0])
        return ways[-1]

    words = [" " + "".join("abc"[int(d)] for d in np.base_repr(n, 3)) for n in range(300)]
    score = {ids: s for s, ids in map(best, words)}
    for word, ids in pieces.segment_words(words, vocabulary).items():
        assert score.get(ids) == best(word)[0], word


def test_only_lengths_of_pieces_are_looked_up():
    """A long piece costs nothing at places where no piece ends in the same characters."""

    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    long = "abcdefghijklmnop"
    vocabulary = pieces.Vocabulary(Counted({letter: (k, -3.0) for k, letter in enumerate(long)} | {long: (99, -4.0)}), [], [], 0, -20.0, len(long))
    assert pieces.segment_words(["p" * 50 + long], vocabulary) == {"p" * 50 + long: (15,) * 50 + (99,)}
    assert Counted.asked <= 2 * 66 + 1


def test_pieces_take_awkward_rows(spark):
    vocabulary = pieces.read_vocabulary(MODEL)
    docs = docs_frame(spark, clash=["ids", "N_TOKENS"])
    coded = pieces.encode(docs, vocabulary)
    got = pieces.decode(coded, vocabulary).collect()
    assert len(got) == len(awkward_docs()) and all(row.round_trip and row.decoded == (row.text or "") and row.n_tokens == len(row.ids) for row in got)
    assert pieces.encode(empty(spark, "doc_id bigint, text string"), vocabulary).count() == 0
    nulls = spark.createDataFrame([(None,)], "ids array<int>")
    assert pieces.decode(nulls, vocabulary).first().decoded is None
