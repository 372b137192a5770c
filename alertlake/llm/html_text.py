"""HTML extraction by consensus host paths.

Pass one scores the containers of each page by the text that stands in them. A container that is only a part of a larger
text (a list, table or section, or one beside text of its parent) counts for that larger one. The page votes for their
generalised paths (tag and classes, digits masked), and Spark adds the votes up per host. Pass two takes the text from the
containers of the host's winning path; pages of a large host are dealt over many tasks. A page without that path uses its own best container; so does a page that has little
text there, unless its best container also stands beside the winner on pages where the winner is best. Votes are added before the shuffle, so a host
with a third of all pages costs no more than another.

Pages are read as a tree: end tags may be left out where HTML allows it, void and self-closed elements hold nothing, and an element
that nothing closes ends with its parent. Elements are boilerplate by tag, role, hidden state or class, wherever they stand. Words
such as "search" or "social" in a class only make an element doubtful: it is left out unless it holds most of the page's text.

Defined results: null or empty html gives an empty text; a page without any container text too. A cut-off tag is dropped, a
cut-off reference stays text. A null or odd url counts as one host of its own. Of paths with equal votes the last in order wins.
Repeated rows give equal texts; other columns are not read. Very long and deeply nested pages take memory in proportion to their length.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.frames import quoted, stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
# Elements whose content is no markup, up to their end tag.
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "noscript", "template", "textarea", "iframe", "title")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that hold other blocks and make up a path.
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table thead tbody tfoot tr td th figure details center dialog menu fieldset".split())
# Elements that begin a new line of text without being part of a path.
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote hr caption figcaption address legend summary".split())
# An element that opens ends those of the first group that are open, up to one of the second.
LISTS, ROWS, CELLS = frozenset("ul ol menu".split()), frozenset("thead tbody tfoot".split()), frozenset("td th".split())
ENDS = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (CELLS, frozenset("tr table".split())),
    "tbody": (ROWS, frozenset(["table"])),
}
ENDS |= {"dd": ENDS["dt"], "th": ENDS["td"], "thead": ENDS["tbody"], "tfoot": ENDS["tbody"]}
TABLE_PARTS = ROWS | CELLS | {"table", "tr", "caption"}
PARAGRAPH = frozenset(["p"])
# Elements that never hold the article.
NOISE_TAGS = frozenset("nav header footer aside form dialog menu label legend button select svg".split()) | RAW.keys()
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
UNSEEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
# Class words that name boilerplate, and words that only make an element doubtful: it is boilerplate unless it holds most of the text.
NOISE_WORD = re.compile(r"ads?|adv|advert\w*|adsby\w+|sponsor\w*|cookies?|consent|notices?|menu|nav\w*|breadcrumbs?|sidebar|footer|header|masthead|comment\w*|replies|disqus", re.I)
DOUBTFUL_WORD = re.compile(r"banner|promo\w*|popup|modal|newsletter|subscribe|widget|related|recommend\w*|share|social|login|search", re.I)
# Class names that say how a page is laid out or filed, and names of an article by themselves.
LABEL = re.compile(r"(?:with|has|no|is|tag|category|type|format|status)[-_].*", re.I)
LAYOUT_WORD = re.compile(r"[-_](?:with|has|no)[-_][\w-]+", re.I)
LAYOUT_TAGS = frozenset("html body main".split())
ARTICLE_NAMES = frozenset("post article entry hentry story".split())
DIGITS = re.compile(r"\d+")
# Elements that are parts of a text; elements that hold one whole.
PARTS = frozenset("section ul ol dl table thead tbody tfoot tr td th figure details center fieldset".split())
WHOLES = frozenset("article main".split())
# Below this share of the text of the page's own best container, the containers of the winning path are not its article.
LITTLE = 0.25
# A host with a larger share of all pages is split into parts of that share; so there are at most 1024 such hosts.
HOT_SHARE = 1 / 1024


@dataclass(slots=True)
class Element:
    """A container. Its path is its own tag and classes and a digest of the path above, so that deep pages stay small."""

    path: str
    tag: str
    noise: bool
    parent: int
    doubtful: bool = False
    score: float = 0.0
    size: int = 0
    plain: float = 0.0


@dataclass(slots=True)
class Block:
    """A piece of text: its element, its text, and its length without links."""

    element: int
    text: str
    plain: float


@dataclass(slots=True)
class Page:
    elements: list[Element]
    blocks: list[Block]


def judged(tag: str, rest: str) -> tuple[list[str], bool, bool]:
    """Classes of an element in general form; whether it is boilerplate by itself; whether its names make it doubtful."""
    noise, doubtful, classes = tag in NOISE_TAGS, False, []
    if not rest or rest.isspace():
        return classes, noise, doubtful
    noise = noise or bool(UNSEEN.search(rest))
    names: list[str] = []
    for kind, value in MARK.findall(rest):
        words = value.strip("\"'").split()
        if kind.lower() == "role":
            noise = noise or any(word.lower() in NOISE_ROLES for word in words)
            continue
        names += words
        if kind.lower() == "class":
            classes = sorted(DIGITS.sub("#", word) for word in words)
    if tag in LAYOUT_TAGS:
        return classes, noise, doubtful
    article = tag == "article" or any(name.lower() in ARTICLE_NAMES for name in names)
    for name in names:
        words = [] if LABEL.fullmatch(name) else [word for word in re.split(r"[-_]+", LAYOUT_WORD.sub("", name)) if word]
        if article and len(words) > 1:
            continue
        noise = noise or any(NOISE_WORD.fullmatch(word) for word in words)
        doubtful = doubtful or any(DOUBTFUL_WORD.fullmatch(word) for word in words)
    return classes, noise, doubtful


def parse(page: str) -> Page:
    """The tree of containers of a page, and its blocks of text in page order; text of boilerplate elements is left out."""
    elements = [Element("", "", False, -1)]
    blocks: list[Block] = []
    # Open elements: tag, the container that text goes to, and whether text is left out.
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    pieces: list[str] = []
    linked = length = 0
    inside_link = False

    def flush() -> None:
        nonlocal linked, length, pieces
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(stack[-1][1], text, len(text) * (1 - linked / max(length, 1))))
            pieces = []
        linked = length = 0

    def add(text: str) -> None:
        nonlocal linked, length
        if stack[-1][2]:
            return
        text = entities.unescape(text) if "&" in text else text
        pieces.append(text)
        length += len(text)
        linked += len(text) if inside_link else 0

    def close(tags: frozenset[str], barriers: frozenset[str]) -> None:
        """End the innermost open element of these tags, and all in it."""
        if not any(opened[tag] for tag in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                opened.subtract(entry[0] for entry in stack[depth:])
                del stack[depth:]
                return
            if stack[depth][0] in barriers:
                return

    at = 0
    while token := TOKEN.search(page, at):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag, rest = tag.lower(), token["rest"]
        block = tag in CONTAINERS or tag in BREAKS
        if tag == "a":
            inside_link = not token["end"]
        elif tag == "br":
            add(" ")
        elif block:
            flush()
        if tag in CONTAINERS:
            inside_link = False
        if token["end"]:
            close(frozenset([tag]), frozenset() if tag in TABLE_PARTS else TABLE_PARTS if block else TABLE_PARTS | CONTAINERS | BREAKS)
            continue
        if block:
            close(PARAGRAPH, TABLE_PARTS)
            if tag in ENDS:
                close(*ENDS[tag])
        if tag in VOID or rest.endswith("/"):
            continue
        if tag in RAW and tag not in unclosed:
            if end := RAW[tag].search(page, at):
                at = end.end()
                continue
            unclosed.add(tag)  # nothing ends it but the end of its parent
        classes, noise, doubtful = judged(tag, rest)
        _, above, skipped = stack[-1]
        if block and (tag in CONTAINERS or doubtful):
            path = hashlib.blake2b(elements[above].path.encode("utf-8", "replace"), digest_size=8).hexdigest()
            elements.append(Element(f"{'.'.join([tag, *classes])}@{path}", tag, noise or skipped, above, doubtful))
            above = len(elements) - 1
        elif not block and not noise:
            continue
        stack.append((tag, above, noise or skipped))
        opened[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    return weighed(Page(elements, blocks))


def weighed(page: Page) -> Page:
    """Settle the doubtful elements by their share of the text, and add up the text of each container."""
    elements, blocks = page.elements, page.blocks
    held = [0.0] * len(elements)
    for block in blocks:
        held[block.element] += block.plain
    total = sum(held)
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
    for i, element in enumerate(elements):
        around = i > 0 and elements[element.parent].noise
        element.noise = element.noise or around or element.doubtful and held[i] <= total / 2
    for block in blocks:
        own = elements[block.element]
        if not own.noise:
            own.score += block.plain
            own.size += len(block.text)
            own.plain += block.plain
            if own.parent >= 0:
                elements[own.parent].score += 0.3 * block.plain
    return page


def wholes(elements: list[Element]) -> list[int]:
    """The element of whose text each element is a part: itself, or an element around it."""
    size, plain = [x.size for x in elements], [x.plain for x in elements]
    for i in range(len(elements) - 1, 0, -1):
        size[elements[i].parent] += size[i]
        plain[elements[i].parent] += plain[i]

    def joins(i: int, above: int) -> bool:
        around = elements[above]
        if around.tag == "article":
            return True
        further = size[above] - size[i]
        if plain[above] - plain[i] < further / 2:
            return False  # mostly links
        return around.tag in WHOLES or around.plain > 0 or elements[i].tag in PARTS and around.tag not in LAYOUT_TAGS | {""}

    found = [0]
    for i in range(1, len(elements)):
        above = elements[i].parent
        found.append(found[above] if not elements[i].noise and joins(i, above) else i)
    return found


def path_scores(elements: list[Element]) -> dict[str, float]:
    scores: dict[str, float] = {}
    for element, whole in zip(elements, wholes(elements), strict=True):
        if not element.noise and element.score > 0:
            scores[elements[whole].path] = scores.get(elements[whole].path, 0.0) + element.score
    return scores


def votes(page: str) -> dict[str, float]:
    """Share of the page's container text by path, the best path first."""
    scores = path_scores(parse(page).elements)
    total = sum(scores.values())
    return {path: score / total for path, score in sorted(scores.items(), key=lambda x: -x[1])}


def below(elements: list[Element], path: str | None) -> set[int]:
    """The elements at the path and all in them, without noise."""
    wanted: set[int] = set()
    for i, element in enumerate(elements):
        if not element.noise and (element.path == path or element.parent in wanted):
            wanted.add(i)
    return wanted


def extract(page: str, path: str | None, beside: Sequence[str] = ()) -> str:
    """Text of the elements at the path, without boilerplate inside them, block by block in page order.

    ``beside`` are the paths known to stand beside the winning path.
    """
    parsed = parse(page)
    elements = parsed.elements
    chosen = below(elements, path)
    scores = path_scores(elements)
    if scores:
        best = max(scores, key=scores.get)
        own = below(elements, best)
        if not chosen or best not in beside and sum(elements[i].plain for i in chosen) < LITTLE * sum(elements[i].plain for i in own):
            chosen = own
    return "\n".join(block.text for block in parsed.blocks if block.element in chosen)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The winning path of each host, and the paths beside it on pages where it is best: (host, path, beside)."""
    read = pages.select(host_of(F.col(quoted(url_col))).alias("host"), F.col(quoted(html_col)).alias("html")).where("html <> ''")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str, str], float] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shares = votes(page)
                best = next(iter(shares), "")
                for path, share in shares.items():
                    found[host, best, path] = found.get((host, best, path), 0.0) + share
            rows = [(*key, share) for key, share in sorted(found.items())]
            kinds = [pa.string()] * 3 + [pa.float64()]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["host", "best", "path", "votes"])

    # Few rows: one per host, best path and path of its pages.
    added = stored(read.mapInArrow(vote, "host string, best string, path string, votes double").groupBy("host", "best", "path").agg(F.sum("votes").alias("votes")), "votes")
    total = added.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    winners = total.groupBy("host").agg(F.max(F.struct(F.round("votes", 6), "path")).alias("won")).select("host", F.col("won.path").alias("winner"))
    # Only paths that are best on some page are ever looked up, which keeps the list short on hosts with generated class names.
    bests = added.select("host", F.col("best").alias("path")).distinct()
    beside = added.join(winners, "host").where(F.col("best") == F.col("winner")).join(bests, ["host", "path"], "left_semi")
    near = winners.join(beside.groupBy("host").agg(F.collect_set("path").alias("beside")), "host", "left")
    return near.select("host", F.col("winner").alias("path"), "beside")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    read = pages.select(F.col(quoted(id_col)).alias("page_id"), F.col(quoted(url_col)).alias("url"), F.col(quoted(html_col)).alias("html"))
    read = read.withColumn("host", host_of(F.col("url")))
    # The few hosts that are split are broadcast; pages of such a host are dealt over its parts, and its one row to each of them.
    room = max(1, math.ceil(pages.count() * HOT_SHARE))
    hot = F.broadcast(stored(read.groupBy("host").agg(F.ceil(F.count("*") / room).alias("parts")).where("parts > 1"), "hosts"))
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    dealt = read.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("url", F.monotonically_increasing_id()), parts))
    winners = host_paths(pages, url_col, html_col).join(hot, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    joined = dealt.drop("parts").join(winners.drop("parts").hint("merge"), ["host", "part"], "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [extract(page, path, beside or ()) if page else "" for page, path, beside in zip(*[batch.column(name).to_pylist() for name in ("html", "path", "beside")], strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array([len(text) for text in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    schema = joined.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema
    return joined.select("page_id", "url", "html", "path", "beside").mapInArrow(texts, schema)
