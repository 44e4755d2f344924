"""Main text of web pages by consensus paths of each host.

A page is read into blocks of text, each with the containers it stands in. Every
container is scored by the text in it, less what is boilerplate or mostly links; the
best one votes, with the key of the generalised path of tags and classes that leads to it. Votes
are added up in Spark by host and path. Then each page is read again and its text
taken from the containers at its host's winning path, or, where the page has none
there or they hold no text, from its own best container.

Boilerplate, wherever it stands, is left out: navigation, headers outside the
article, footers, asides, forms and their buttons, labels and choices, notices, adverts,
share bars, reader comments, scripts, styles, inside a paragraph too. A page is read
once, from left to right, and sums go from the inner nodes to the outer ones in one pass,
so malformed and deeply nested pages take time in proportion to their length. White space inside a block becomes one space, blocks are joined by
one line feed in page order.

Edge cases: a null or empty page has an empty text; a page without tags is one block;
a tag that never ends is text; ids may be null or repeat, each row is read by itself; a null url belongs to the host
"" with others of its kind; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import checkpointed
from fleetscope.llm.urlfilter import parts

MOST_BROADCAST_HOSTS = 50_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Blocks that hold text but are no candidates.
LEAF = frozenset("address blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 hr li option p pre summary".split())
DROPPED = frozenset("aside button datalist dialog fieldset footer form head iframe input label menu nav noscript object select svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id names.
BAD = frozenset("ad ads adsbygoogle advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promos promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
GOOD = frozenset("article body content entry main post story text".split())
#: Of these, those that speak of boilerplate at any place in a name.
STRONG = frozenset("ad ads advert adverts advertisement comment comments cookie cookies disqus newsletter replies reply sidebar sponsor sponsored".split())
RELATIVE = frozenset("has no with without".split())
CLOSES_P = BLOCK - {"html", "body", "head", "option", "optgroup", "title"}
SIBLINGS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
RAW = frozenset("script style noscript template svg textarea iframe".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""", re.S)
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VARYING = re.compile(r"[0-9a-f]*[0-9][0-9a-f]*")


class Node:
    """A block element: its place in the tree, the key of its path, and the text and linked text in it, first its own, then all."""

    __slots__ = ("article", "bad", "closed", "depth", "gain", "inside", "links", "parent", "path", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, label: str, bad: bool):
        self.tag, self.parent, self.bad = tag, parent, bad
        self.depth = parent.depth + 1 if parent else 0
        self.path = hashlib.blake2b(f"{parent.path}/{label}".encode(), digest_size=8).hexdigest() if parent else ""
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.text = self.links = self.gain = 0
        self.closed = self.inside = False


def _names_bad(names: str) -> bool:
    """Class or id names that speak of boilerplate: by a strong word, by the last one, or by the first without a word for content."""
    for name in names.split():
        words = [w.lower() for w in NAME_PART.findall(name)]
        if not words or RELATIVE & set(words):
            continue
        good = GOOD & set(words)
        if STRONG & set(words) or words[-1] in BAD and not (good and words[-1] == "header") or words[0] in BAD and not good:
            return True
    return False


def _strong_names(names: str) -> bool:
    return any(STRONG & words and not RELATIVE & words for words in ({w.lower() for w in NAME_PART.findall(name)} for name in names.split()))


def tokens(page: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """Text, then the tag after it (None at the end of the page), whether it closes, and its attributes. Comments and elements of raw text are left out."""
    at = begin = 0
    quoted, pieces = True, []
    while True:
        at = page.find("<", at)
        if at < 0 or page.find(">", at) < 0 and not page.startswith("<!--", at):
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at)
            pieces.append(page[begin:at])
            begin = at = end + 3 if end >= 0 else len(page)
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            pieces.append(page[begin:at])
            begin = at = page.find(">", at) + 1
            continue
        if not (page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/"):
            at += 1
            continue
        found = TAG.match(page, at) if quoted else None
        if found is None:
            # A quote that never ends; from here on, quotes mean nothing.
            found = PLAIN_TAG.match(page, at)
            quoted = quoted and page[at + 1 : at + 3].lstrip("/")[:1].isalpha() is False
        if found is None:
            at += 1
            continue
        pieces.append(page[begin:at])
        begin = at = found.end()
        tag = found[2].lower()
        if tag in RAW:
            if not found[1]:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                begin = at = end.end() if end else len(page)
            continue
        yield "".join(pieces), tag, bool(found[1]), found[3]
        pieces = []
    pieces.append(page[begin:])
    yield "".join(pieces), None, False, ""


def blocks(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All nodes, outer before inner, and the text blocks in page order, each with its innermost node."""
    root = Node("", None, "", False)
    node, nodes, out, pieces, link, linked = root, [root], [], [], False, 0
    opened: dict[str, int] = {}
    # The outermost inline element whose text is left out: its tag, how many of that name are open in it, its block.
    muted: list | None = None

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((node, text))
                if node.bad:
                    node.gain -= len(text)
                else:
                    node.text += len(text)
                    node.links += min(linked, len(text))
            pieces.clear()
            linked = 0

    def leave(top: Node) -> Node:
        """Closes the open nodes up to ``top``."""
        up = node
        while True:
            up.closed = True
            opened[up.tag] -= 1
            if up is top:
                return up.parent
            up = up.parent

    for text, tag, ends, attributes in tokens(page):
        if text:
            if muted is None:
                pieces.append(text)
                if link:
                    linked += len(text)
            elif not text.isspace():
                node.gain -= len(text)
        if tag is None:
            break
        if tag == "br":
            pieces.append("\n")
            continue
        if muted is not None and tag == muted[0]:
            muted[1] += -1 if ends else 1
            if not muted[1]:
                if node is not muted[2]:
                    close()
                    up = node
                    while up.parent is not muted[2]:
                        up = up.parent
                    node = leave(up)
                muted = None
            continue
        if tag == "a":
            link = not ends
        names, bad, classes = [], tag in DROPPED, ""
        if not ends and attributes and not attributes.isspace():
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "class":
                    classes = value
                if name in ("class", "id"):
                    names.append(value)
                elif tag not in ("html", "body", "main"):
                    bad = bad or name == "hidden" or name == "role" and value.lower() in ROLES or name == "style" and bool(UNSEEN.search(value))
        if tag not in BLOCK:
            if muted is None and not ends and tag not in VOID and (bad or any(map(_strong_names, names))):
                muted = [tag, 1, node]
            continue
        close()
        link = False
        if ends:
            if opened.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up)
        else:
            if tag in CLOSES_P and node.tag == "p":
                node = leave(node)
            if tag in SIBLINGS and any(opened.get(t) for t in SIBLINGS[tag][0]):
                same, stop = SIBLINGS[tag]
                up = node
                while up.parent is not None and up.tag not in same and up.tag not in stop:
                    up = up.parent
                if up.tag in same:
                    node = leave(up)
        if muted is not None and muted[2].closed:
            muted = None
        if ends or tag in VOID:
            continue
        bad = bad or node.bad or muted is not None or tag == "header" and not node.article or tag not in ("html", "body", "main") and any(map(_names_bad, names))
        kind = "." + ".".join(sorted(VARYING.sub("#", c.lower()) for c in classes.split())) if classes.strip() else ""
        node = Node(tag, node, tag + kind, bad)
        nodes.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    close()
    return nodes, out


def best_container(nodes: list[Node]) -> Node | None:
    """The container with the largest score, the text in it that is not mostly links, less the boilerplate in it; of equals the innermost."""
    for node in reversed(nodes):
        if node.parent is not None:
            up = node.parent
            up.text, up.links, up.gain = up.text + node.text, up.links + node.links, up.gain + node.gain

    def score(node: Node) -> float:
        own = node.gain + node.text - 2 * node.links
        return own * 1.2 if own > 0 and node.tag in ("article", "main") else own

    return max((x for x in nodes if x.text and not x.bad and x.tag not in LEAF), key=lambda x: (score(x), x.depth), default=None)


def text_of(page: str, path: str | None) -> str:
    """Text at ``path``, else in the page's best container."""
    nodes, found = blocks(page)
    chosen: list[str] = []
    for best in (path, None):
        best = best_container(nodes) if best is None else best
        for node in nodes:
            node.inside = node is best or node.path == best or bool(node.parent and node.parent.inside)
        chosen = [text for node, text in found if node.inside and not node.bad]
        if chosen:
            break
    return "\n".join(chosen)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path``: the key of the path with most votes of a host's pages; of equals that with most text, then the least key."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [best_container(blocks(x)[0]) if x else None for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([b.path if b else None for b in best], pa.string()), pa.array([b.text if b else 0 for b in best], pa.int64())], ["host", "path", "chars"])

    rows = pages.select(parts(F.col(url_col))[0].alias("host"), F.col(html_col).cast("string").alias("html"))
    votes = rows.mapInArrow(vote, "host string, path string, chars long").where("path IS NOT NULL")
    votes = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("chars").alias("chars"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("chars"), "path")
    return votes.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("host", "path")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``, a row for each row of ``pages``."""
    winners = checkpointed(host_paths(pages, url_col, html_col))
    if winners.count() <= MOST_BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), parts(F.col(url_col))[0].alias("host")).join(winners, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(page, path) for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.select("page_id", "url", "html", "path").mapInArrow(read, f"page_id {kind}, url string, text string")
