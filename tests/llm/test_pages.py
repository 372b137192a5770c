import glob
import os
import tracemalloc

import pytest

from alertlake.llm import html_text

LONG = "A long article with many words that goes on and on, and then ends. " * 4
TEXT = LONG.strip()
SF_DIR = os.environ.get("ALERTLAKE_SF_DIR", "/root/testdata/sf0.001")
PAGES = "page_id bigint, url string, html string"


def alone(body):
    page = f"<html><body>{body}</body></html>"
    return html_text.extract(page, next(iter(html_text.votes(page)), None))


@pytest.mark.parametrize(
    "before",
    ["<svg/>", "<div><button>menu</div>", "<div><p><select><option>a<option>b</div>", "<div><iframe src=x></div>", "<div><svg><title>t</div>", "</div></p></b>", "<td>"],
)
def test_what_is_left_open_ends_with_its_parent(before):
    assert alone(f"{before}<div class='m'><p>{LONG}</p></div>") == TEXT


@pytest.mark.parametrize("name", ["post tag-search", "content-social", "entry related-topics", "has-sidebar", "story with-comments", "article-with-sidebar"])
def test_words_in_a_class_do_not_drop_the_article(name):
    assert alone(f"<div class='{name}'><p>{LONG}</p></div><div class='box'><p>short other box</p></div>") == TEXT


@pytest.mark.parametrize(
    "noise",
    [
        "<p class=advert>no</p>", "<div class='adsbygoogle'>no</div>", "<ol class=commentlist><li>no</ol>", "<ul><li class=comment>no</ul>",
        "<dialog class=cookie>no</dialog>", "<p hidden>no</p>", "<div aria-hidden=true>no</div>", "<p style='display:none'>no</p>", "<label>no</label>",
        "<legend>no</legend>", "<p>x <span style='color:red; display: none'>no</span></p>", "<div role=search>no</div>", "<div class='social-share'>no</div>",
        "<div class='newsletter'><p>no</p></div>", "<nav>no</nav>", "<div id=comments><div><p>no</p></div></div>", "<form>no<p>no</form>", "<button>no</button>",
    ],
)
def test_boilerplate_on_any_element_goes(noise):
    got = alone(f"<article><p>{LONG}</p>{noise}<p>{LONG}</p></article>").split("\n")
    assert [line for line in got if line != "x"] == [TEXT, TEXT]


def test_hidden_in_other_names_stays():
    assert alone(f"<article><p data-hidden-by=x title='display:none' class='unhidden'>{LONG}</p></article>") == TEXT


def test_end_tags_that_may_be_left_out():
    rows = "".join(f"<tr><td>cell {i} of the table<td>value {i}" for i in range(30))
    assert alone(f"<table><thead><tr><th>name<th>value<tbody>{rows}</table>").split("\n")[:4] == ["name", "value", "cell 0 of the table", "value 0"]
    assert alone(f"<div><p>{LONG}<p>{LONG}<ul><li>one<li>two<ul><li>three</ul><li>four</ul><dl><dt>a<dd>b</dl></div>").split("\n") == [TEXT, TEXT, "one", "two", "three", "four", "a", "b"]
    parsed = html_text.parse("<table>" + rows + "</table>")
    depth = [0]
    for element in parsed.elements[1:]:
        depth.append(depth[element.parent] + 1)
    assert max(depth) == 3


@pytest.mark.parametrize("piece, count", [("<tr><td>cell text of a row<td>b", 32_000), ("<div class=a>", 40_000), ("<svg><iframe>", 40_000), ("<p>some text</b>", 40_000)])
def test_long_and_deep_pages_stay_small(piece, count):
    page = "<table>" + piece * count + "last words of the page"
    tracemalloc.start()
    parsed = html_text.parse(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    assert parsed.blocks or "svg" in piece


def test_votes_equal_a_count_over_all_pages(spark):
    if not glob.glob(f"{SF_DIR}/pages.parquet"):
        pytest.skip("no pages")
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html")
    extra = [(-i, f"http://own.example/{i}", f"<div class='c{'ab'[i % 3 == 0]}'><p>{LONG}</p></div><div class='d'><p>few words {i}</p></div>") for i in range(1, 40)]
    pages = pages.union(spark.createDataFrame(extra, PAGES))
    rows = pages.withColumn("host", html_text.host_of(pages.url)).collect()
    counted, beside = {}, {}
    for row in rows:
        shares = html_text.votes(row.html) if row.html else {}
        for path, share in shares.items():
            counted.setdefault(row.host, {}).setdefault(path, []).append(share)
            beside.setdefault((row.host, next(iter(shares))), set()).add(path)
    winners = {host: max((round(sum(shares), 6), path) for path, shares in paths.items())[1] for host, paths in counted.items()}
    got = {row.host: row.path for row in html_text.host_paths(pages).collect()}
    assert got == winners
    want = sorted((row.page_id, html_text.extract(row.html, winners.get(row.host), beside.get((row.host, winners.get(row.host)), ())) if row.html else "") for row in rows)
    assert sorted((row.page_id, row.text) for row in html_text.extract_text(pages).collect()) == want


def test_equal_votes_and_repeated_rows(spark):
    page = f"<div class='a'><p>{LONG}</p></div><div class='b'><p>{LONG}</p></div>"
    frame = spark.createDataFrame([(1, "http://h/1", page), (1, "http://h/1", page), (None, None, page), (3, "x", None), (4, "x", "")], PAGES)
    got = [row.text for row in html_text.extract_text(frame).collect()]
    assert sorted(got) == ["", "", TEXT, TEXT, TEXT]
