"""Main text of web pages by scoring the block tree.

Block elements form a tree; inline elements only matter for link density.
Boilerplate elements are cut off, paragraphs pass points for length and commas
to their ancestors, the best container by points discounted by link density is
kept with those siblings that score enough.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template iframe svg textarea title math object noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset("nav footer aside form dialog menu search button select label fieldset head".split())
#: Words in class or id that mark boilerplate.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discuss discussion disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion recommended related remark replies reply respond sidebar share sharing shoutbox signup skyscraper social sponsor sponsored subscribe subscription taboola toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
_PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption summary tr tbody thead ul ol dl".split())
_WHOLE = frozenset(("article", "main"))
LEAST_CHARS = 25  # shorter paragraphs pass no points
BARE = 0.2  # share of its points that text passes which stands in a division itself, in no paragraph
MOST = 0.8  # an element with more of the page's paragraphs than this is no boilerplate by its class, nor a form
SIBLING = 0.2  # share of the best score that keeps a sibling
LINKED = 0.5  # lists, tables and divisions with a larger share of link text are menus


class _Tree:
    def __init__(self):
        self.tag, self.parent, self.cut = ["#root"], [-1], [0]  # cut: 1 boilerplate, 2 by class, id or as a form
        self.pieces: list[tuple[int, str, bool]] = []  # node, text, in a link

    def add(self, tag: str, parent: int, cut: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.cut.append(cut)
        return len(self.tag) - 1


class _Open:
    """The open block elements, with the places of each tag on the stack, so that no search walks over the others."""

    def __init__(self, tree: _Tree):
        self.tree, self.stack, self.places = tree, [0], {}

    @property
    def node(self) -> int:
        return self.stack[-1]

    @property
    def tag(self) -> str:
        return self.tree.tag[self.stack[-1]]

    def last(self, *tags: str) -> int:
        """The deepest place of any of the tags; 0, where the root is, if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, tag: str, cut: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(self.tree.add(tag, self.stack[-1], cut))

    def drop_to(self, place: int) -> bool:
        """Closes what stands from a place on; whether a block was among that."""
        gone = [self.tree.tag[i] for i in self.stack[place:]]
        for tag in gone:
            self.places[tag].pop()
        del self.stack[place:]
        return any(tag in BLOCKS for tag in gone)


class _Marks:
    """Finds the markup of a page in one pass: no character is looked at again after a search that failed."""

    def __init__(self, page: str):
        self.page, self.last_end = page, page.rfind(">")
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.quotes = True  # quoted attributes may hold ">"; not after a quote that swallowed the rest of the page

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends here; -1 if it never does."""
        page, k = self.page, at
        if at > self.last_end:
            return -1
        while self.quotes:
            k = _UNQUOTED.match(page, k).end()
            if k == len(page):
                self.quotes = False
            elif page[k] == ">":
                return k
            elif self.last_quote[page[k]] > k:
                k = page.index(page[k], k + 1) + 1
            else:
                k += 1
        return page.find(">", at)

    def comment_end(self, at: int) -> int:
        """Where the rest begins after the comment or declaration at ``<!`` or ``<?``."""
        if self.page.startswith("<!--", at):
            end = self.page.find("-->", at + 2)
            return len(self.page) if end < 0 else end + 3
        end = self.page.find(">", at)
        return len(self.page) if end < 0 else end + 1

    def raw_end(self, tag: str, at: int) -> int:
        """Where the rest begins after a raw element's content."""
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        end = self.tag_end(found.end()) if found else -1
        return len(self.page) if end < 0 else end + 1


def _boilerplate(tag: str, attrs: str, inside: bool) -> int:
    if tag in CUT and tag != "form" or tag == "header" and not inside:
        return 1
    kind = 2 if tag == "form" else 0
    if not attrs or tag in ("html", "body", "article", "main"):
        return kind
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and not MARKS.isdisjoint(w.lower() for w in _WORD.findall(value)):
            kind = 2
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 1
    return kind


def _parse(page: str) -> _Tree:
    tree = _Tree()
    marks, opened, links, at = _Marks(page), _Open(tree), 0, 0
    skips: list[str] = []  # inline elements that are boilerplate
    n = len(page)

    def text(raw: str) -> None:
        if raw and not skips:
            tree.pieces.append((opened.node, html.unescape(raw), links > 0))

    def drop_to(place: int) -> None:
        nonlocal links
        if opened.drop_to(place):
            links = 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            text(page[lt + 9 : end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), lt):
            at = marks.comment_end(lt)
            continue
        closing = page.startswith("</", lt)
        name = _NAME.match(page, lt + 1 + closing)
        if not name and closing:
            at = marks.comment_end(lt)
            continue
        if not name:
            text("<")
            at = lt + 1
            continue
        end = marks.tag_end(name.end())
        if end < 0:  # the page ends within a tag
            break
        tag, attrs, at = name[0].lower(), page[name.end() : end], end + 1
        if tag in RAW and not closing:
            if not attrs.rstrip().endswith("/"):
                at = marks.raw_end(tag, at)
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in ("br", "hr"):
            tree.pieces.append((opened.node, "\n", False))
            continue
        if tag in VOID:
            continue
        if closing:
            if skips and skips[-1] == tag:
                skips.pop()
            elif place := opened.last(tag):
                drop_to(place)
                skips.clear()
            continue
        if tag not in BLOCKS and tag not in CUT:
            if skips and skips[-1] == tag or _boilerplate(tag, attrs, True):
                skips.append(tag)
            continue
        if tag == "body":
            skips.clear()
            if place := opened.last("head"):  # an open head ends here
                drop_to(place)
        if tag in _CLOSES:
            while (place := opened.last(*_CLOSES[tag])) > opened.last(*_SCOPE[tag]):
                drop_to(place)
        elif tag in BLOCKS and opened.tag == "p":
            drop_to(len(opened.stack) - 1)
        opened.push(tag, _boilerplate(tag, attrs, opened.last(*_WHOLE) > 0))
    return tree


def _cuts(tree: _Tree) -> list[bool]:
    """What is boilerplate; by its class or as a form only what holds neither the main article nor most paragraphs."""
    tags, parent, n = tree.tag, tree.parent, len(tree.tag)
    cut = [kind == 1 for kind in tree.cut]
    for k in range(1, n):
        cut[k] = cut[k] or cut[parent[k]]
    marked, inside = [kind == 2 for kind in tree.cut], [tag in _WHOLE for tag in tags]
    for k in range(1, n):
        marked[k] = marked[k] or marked[parent[k]]
        inside[k] = inside[k] or inside[parent[k]]
    plain = False  # there is text in an article that no mark cuts
    own, linked = [0] * n, [0] * n
    for node, piece, link in tree.pieces:
        if not cut[node]:
            plain = plain or inside[node] and not marked[node] and bool(piece.strip())
            own[node] += len(piece.strip())
            linked[node] += len(piece.strip()) * link
    held = [a - b if a >= LEAST_CHARS else 0 for a, b in zip(own, linked)]
    for k in range(n - 1, 0, -1):
        held[parent[k]] += held[k]
    spared = {k for k in range(n) if held[k] > MOST * held[0] and (inside[k] or not plain)}
    whole = max((k for k in range(n) if tags[k] in _WHOLE and not cut[k]), key=lambda k: (held[k], -k), default=0)
    if 2 * held[whole] > held[0]:
        while whole > 0:
            spared.add(whole)
            whole = parent[whole]
    for k in range(1, n):
        cut[k] = cut[k] or cut[parent[k]] or tree.cut[k] == 2 and k not in spared
    return cut


def main_text(page: str | None) -> str:
    """The article of a page; an empty text where there is none."""
    if not page:
        return ""
    tree = _parse(page)
    marked = 2 in tree.cut
    tree.cut = _cuts(tree)
    text = _article(tree)
    if not text and marked:
        tree = _parse(page)
        tree.cut = [kind == 1 for kind in tree.cut]
        for k in range(1, len(tree.cut)):
            tree.cut[k] = tree.cut[k] or tree.cut[tree.parent[k]]
        text = _article(tree)
    return text


def _article(tree: _Tree) -> str:
    tags, parent, n = tree.tag, tree.parent, len(tree.tag)
    own, linked = [0] * n, [0] * n
    texts: list[list[str]] = [[] for _ in range(n)]
    for node, piece, link in tree.pieces:
        if not tree.cut[node]:
            size = len(piece.strip())
            own[node] += size
            linked[node] += size * link
            texts[node].append(piece)
    total, total_linked = own[:], linked[:]
    for k in range(n - 1, 0, -1):
        total[parent[k]] += total[k]
        total_linked[parent[k]] += total_linked[k]
    for k in range(1, n):
        if not tree.cut[k] and tags[k] in ("ul", "ol", "dl", "table", "div", "section") and total[k] and total_linked[k] > LINKED * total[k]:
            tree.cut[k] = True
        tree.cut[k] = tree.cut[k] or tree.cut[parent[k]]

    # A paragraph's points go to its container, half of them to that one's, and so on up to the root.
    points = [0.0] * n
    for k in range(n - 1, -1, -1):
        plain = tags[k] not in _PARAGRAPH or k == 0
        if not tree.cut[k] and own[k] >= LEAST_CHARS:
            said = " ".join("".join(texts[k]).split())
            gain = 1 + said.count(",") + min(len(said) / 100, 3) + len(said) / 1000
            points[k if plain else parent[k]] += gain * (1 - linked[k] / max(own[k], 1)) * (BARE if plain else 1)
        if k:
            points[parent[k]] += points[k] / 2 if plain else points[k]
    score = [points[k] * (1 - total_linked[k] / max(total[k], 1)) for k in range(n)]
    best = max((k for k in range(n) if not tree.cut[k] and (tags[k] not in _PARAGRAPH or k == 0)), key=lambda k: (score[k], -k))
    if score[best] <= 0:
        whole = [k for k in range(n) if tags[k] in _WHOLE and not tree.cut[k] and total[k]]
        best = max(whole, key=lambda k: (total[k], -k)) if whole else 0
    at = best
    while at > 0:  # an article element around the best container is the article
        if tags[at] in _WHOLE:
            best = at
        at = parent[at]
    kept = [False] * n
    kept[best] = True
    if best and tags[best] not in _WHOLE:
        for k in range(1, n):
            if k != best and parent[k] == parent[best] and not tree.cut[k]:
                density = total_linked[k] / max(total[k], 1)
                kept[k] = score[k] >= SIBLING * score[best] or tags[k] in ("p", "pre", "blockquote", "h1", "h2") and density < 0.25
    for k in range(1, n):
        kept[k] = (kept[k] or kept[parent[k]]) and not tree.cut[k]
    out, last = [], None
    for node, piece, _ in tree.pieces:
        if kept[node]:
            if last is not None and node != last:
                out.append("\n")
            out.append(piece)
            last = node
    return " ".join("".join(out).split())


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, from its whole html.

    Null and empty html give an empty text, as does a page without any text
    outside boilerplate; markup that is never closed runs to the end of the page,
    and a tag that the page ends in gives nothing. Time is linear in the page.
    Repeated rows stay; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(released(_extracted), "page_id long, url string, text string, n_chars long")
