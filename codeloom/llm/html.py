"""Main text of web pages by tree scoring.

The page becomes a tree of elements and text. Scripts, styles, comments and the like are not read; forms, labels
and hidden elements are left out unless they hold most of the page. Names (class, id, role) mark menus, adverts, notices
and comments, but not an element that holds the article or much of the page's text; if almost nothing is left, names do not count. Every paragraph-like block gives points for its length and its commas to its parent and,
halved, to its grandparent and so on (discounted at each level). A container's score is its points
times (1 - the share of its text inside links), with a bonus or malus for its tag and names. The
best container is kept with those of its siblings that score well or read like prose; inside them
menus, adverts, notices, comments, forms and lists of short links before any prose are left out. Blocks: runs of text between
block-level tags; character references are decoded, white space becomes one space.

A page is read once from front to end: open elements are found by tag in constant time, so unbalanced
quotes and tags that are never closed cost no more than others.

Cost: one pass in Arrow batches, a page at a time; nothing is shuffled or gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HARD = frozenset("script style noscript template iframe object title desc metadata annotation annotation-xml select textarea canvas audio video".split())
SOFT = frozenset("form button fieldset label dialog".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mpadded svg g text tspan".split())
BOILER = frozenset("nav header footer aside menu".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag on the left ends an open element on the right, up to the nearest of the third.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: End tags of the first end elements across cells; no other end tag does. Inline ones end nothing outside the third.
TABLE = frozenset("table tbody thead tfoot tr td th body html".split())
CELLS = frozenset("table td th".split())
LIMITS = frozenset("table td th article body".split())
PARAGRAPH = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_FURNITURE = r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|nav(?:bar|igation|links?|menu)?|menu|breadcrumbs?|sidebar|side-?bar|widget|related|recommend\w*|share|sharing|social|toolbar|pagination|pager|tags?|comments?|comment-?list|disqus|respond|replies|footer|foot|header|masthead|copyright|legal|login|search)"
FURNITURE = re.compile(rf"(?:^|[-_]){_FURNITURE}(?:$|[-_\d])", re.I)
WHOLE = re.compile(rf"{_FURNITURE}[-_\d]*", re.I)
COMMENTS = re.compile(r"(?:^|[-_])(?:comments?|disqus|respond|replies)(?:$|[-_\d])", re.I)
#: Characters of a block from which on it is prose.
PROSE = 80
#: A class word that begins so tells of a page's layout or subject, not of the element's role.
STATE = re.compile(r"(?:has|with|without|no|not|is|tag)[-_]", re.I)
CONTENT = re.compile(r"(?:^|[-_\s])(?:article|content|post|entry|main|body|story|text|page)(?:$|[-_\s\d])", re.I)
#: An attribute of a tag; nothing is tried twice.
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile(r">|=\s*+[\"']")
_END = {t: re.compile(rf"</{t}(?:[\s/][^>]*+)?>", re.I) for t in RAW}
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("children", "core", "drop", "in_article", "link_len", "links", "menus", "names", "outer", "parent", "points", "size", "skip", "tag", "text_len", "titled")

    def __init__(self, tag: str, names: str, parent: Node | None) -> None:
        self.tag, self.names, self.parent, self.children, self.points, self.text_len, self.link_len, self.links = tag, names, parent, [], 0.0, 0, 0, 0
        self.skip, self.drop, self.core, self.size, self.titled, self.menus = "hard" if tag in HARD else "soft" if tag in SOFT else "", "", False, 0, False, False
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article")
        #: the nearest element above that is a container
        self.outer = parent if parent is None or parent.tag not in INLINE and parent.tag != "p" else parent.outer


class _Open:
    """The open elements. depths: by tag, their places in the path; blocks: the places of those that are not inline."""

    def __init__(self) -> None:
        self.root = Node("#root", "", None)
        self.path, self.depths, self.blocks = [self.root], {}, [0]

    @property
    def cur(self) -> Node:
        return self.path[-1]

    def deepest(self, tags: frozenset[str] | set[str]) -> int:
        """The place of the nearest open element with one of the tags; -1 if none is open."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def push(self, node: Node) -> None:
        self.cur.children.append(node)
        self.depths.setdefault(node.tag, []).append(len(self.path))
        if node.tag not in INLINE:
            self.blocks.append(len(self.path))
        self.path.append(node)

    def close(self, depth: int) -> None:
        """Ends the element at a place, and those inside it."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.depths[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()


def _tags(html: str) -> Iterator[tuple[str, str, str]]:
    """(text before, tag as written with its slash or "", attributes) in order; every character is looked at a fixed number of times.

    A quoted value may hold >; a quote that never ends is an ordinary sign; a tag that never ends is text."""
    at = text = 0  # text: what is not given out yet
    endless: set[str] = set()  # what does not occur any more
    n = len(html)
    while True:
        i = html.find("<", at)
        if i < 0:
            break
        if html.startswith("<!--", i):
            end = html.find("-->", i + 2) if "-->" not in endless else -1
            if end < 0:
                endless.add("-->")
                end = html.find(">", i)
            yield html[text:i], "", ""
            at = text = n if end < 0 else html.find(">", end) + 1
            continue
        if html.startswith(("<!", "<?"), i):
            end = html.find(">", i)
            yield html[text:i], "", ""
            at = text = n if end < 0 else end + 1
            continue
        slash = html.startswith("/", i + 1)
        m = _NAME.match(html, i + 1 + slash)
        if not m:
            at = i + 1
            continue
        j = m.end()
        while True:
            stop = _STOP.search(html, j)
            if not stop:
                j = -1
                break
            j = stop.end()
            if html[j - 1] == ">":
                break
            quote = html[j - 1]
            end = html.find(quote, j) if quote not in endless else -1
            if end < 0:
                endless.add(quote)
            else:
                j = end + 1
        if j < 0:  # a quote swallowed the rest of the page: from here on quotes are ordinary signs
            endless |= {'"', "'"}
            j = html.find(">", i) + 1
            if not j:
                break
        yield html[text:i], ("/" if slash else "") + m.group(), html[m.end() : j - 1]
        at = text = j
        tag = m.group().lower()
        if tag in RAW and not slash and not html[m.end() : j - 1].rstrip().endswith("/"):  # its content is not markup
            end = _END[tag].search(html, at) if tag not in endless else None
            if end:
                at = text = end.end()
            else:
                endless.add(tag)
                if tag != "title":  # a title that never ends ends with the next tag
                    return
                at = text = html.find("<", at) if html.find("<", at) >= 0 else n
    if text < n:
        yield html[text:], "", ""


def parse(html: str) -> Node:
    """The tree of a page: children are nodes or strings (not decoded); what is in RAW is left out."""
    o = _Open()
    for text, tag, rest in _tags(html):
        if text:
            o.cur.children.append(text)
        if not tag:
            continue
        tag = tag.lower()
        if tag[0] == "/":
            tag = tag[1:]
            depth = o.deepest({tag})
            if tag not in TABLE and depth > o.deepest(CELLS) and (tag not in INLINE or depth > o.deepest(LIMITS)) or tag in TABLE and depth > 0:
                o.close(depth)
            elif tag == "br":
                o.cur.children.append(Node("br", "", o.cur))
            continue
        if tag in RAW:
            continue
        names = ""
        if "=" in rest or "hidden" in rest:
            found: dict[str, str] = {}
            for k, *v in _ATTR.findall(rest):
                found.setdefault(k.lower(), v[0] or v[1] or v[2])
            if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
                names = "hidden"
            else:
                names = " ".join(found[k] for k in ("class", "id", "role") if found.get(k))
        if tag in VOID or rest.rstrip().endswith("/") and tag not in CLOSES_P:
            o.cur.children.append(Node(tag, names, o.cur))
            continue
        if tag == "head":  # its end tag may be missing
            continue
        if tag in CLOSES_P and o.path[o.blocks[-1]].tag == "p":  # an open p ends, with the inline elements in it
            o.close(o.blocks[-1])
        if tag in HEADING and o.cur.tag in HEADING:
            o.close(len(o.path) - 1)
        if tag in ENDS:
            ends, stop = ENDS[tag]
            while (depth := o.deepest(ends)) > o.deepest(stop):
                o.close(depth)
        node = Node(tag, names, o.cur)
        if names == "hidden" and tag not in HARD and tag not in ("html", "body"):
            node.skip = "hidden"
        o.push(node)
    return o.root


def _own_header(x: Node, total: int) -> bool:
    """Whether a header is an article's, by what it holds and where it stands: in an article element; or with an h1, without menus, and either beside
    paragraphs or in a part of the page that holds most of its text and no other furniture."""
    if x.in_article:
        return True
    if not x.titled or x.menus or x.parent is None:
        return False
    beside = [c for c in x.parent.children if isinstance(c, Node) and c is not x]
    if sum(c.size for c in beside if c.tag == "p") > 80:
        return True
    return x.parent.tag not in ("body", "html", "#root") and x.parent.size >= 0.5 * total and not any(c.tag in BOILER for c in beside)


def _furniture(x: Node, total: int) -> bool:
    if x.tag == "header":
        return not _own_header(x, total)
    if x.tag in BOILER:
        return True
    if not x.names or x.tag in ("body", "html", "article", "main"):
        return False
    words = [w for w in _CAMEL.sub("-", x.names).split() if FURNITURE.search(w) and not STATE.match(w)]
    if not words or x.core and x.size > 0.1 * total:
        return False
    if any(COMMENTS.search(w) for w in words):
        return True
    return x.size <= (0.5 if any(WHOLE.fullmatch(w) for w in words) else 0.2) * total


def _judge(root: Node, by_name: bool) -> int:
    """Sets drop ("skip", "furniture" or "") of every element; returns the length of the page's text.

    size: text in an element, what is never read left out; core: it holds an article, main or h1; titled: an h1; menus: a nav, menu or list."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        x.core = x.tag in ("main", "h1") or x.tag == "article" and not any(COMMENTS.search(w) for w in _CAMEL.sub("-", x.names).split())
        x.titled, x.menus = x.tag == "h1", x.tag in ("nav", "menu", "ul", "ol", "form")
        x.size = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        stack.extend(c for c in x.children if isinstance(c, Node) and c.skip != "hard")
        for c in x.children:
            if isinstance(c, Node) and c.skip == "hard":
                c.drop = "skip"
    for x in reversed(order):
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.core |= x.core
            x.parent.titled |= x.titled
            x.parent.menus |= x.menus
    total = root.size
    for x in order:
        x.drop = ""
        if x.skip == "hidden" and not (x.core and x.size > 0.5 * total) or x.skip == "soft" and x.size <= 0.5 * total and not (x.core and x.size > 0.25 * total):
            x.drop = "skip"
        elif by_name and _furniture(x, total):
            x.drop = "furniture"
    return total


def _measure(root: Node) -> list[Node]:
    """Text and link lengths of every element, points of the containers; elements in page order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node) and not c.drop)
    for x in order:
        x.points, x.text_len, x.link_len, x.links = 0.0, 0, 0, 0
    for x in reversed(order):
        own = commas = 0
        for c in x.children:
            if isinstance(c, str):
                t = c.strip()
                own += len(t)
                commas += t.count(",")
        x.text_len += own
        if x.tag == "a":
            x.link_len, x.links = x.text_len, 1
        if x.parent is not None:
            x.parent.text_len += x.text_len
            x.parent.link_len += x.link_len
            x.parent.links += x.links
        block = x.tag in PARAGRAPH or own > 80 and x.tag not in INLINE
        length = x.text_len if x.tag in PARAGRAPH else own
        if block and length > 0 and x.tag not in HEADING:
            give = 1 + commas + min(length / 100, 3) if length >= 25 else 0.2
            up, share = x.outer if x.tag in PARAGRAPH or x.tag in INLINE else x, 1.0
            while up is not None and share > 0.1:
                up.points += give * share
                share /= 2
                up = up.outer
    return order


def _score(x: Node) -> float:
    bonus = 1.0
    if x.tag in ("article", "main"):
        bonus = 1.5
    elif x.names and CONTENT.search(x.names):
        bonus = 1.25
    return x.points * bonus * (1 - x.link_len / x.text_len if x.text_len else 0)


def _menu(x: Node) -> bool:
    """Whether an element is a list of short links; that is a menu if no prose stands before it (else it is the article's: its sources)."""
    if x.in_article or x.tag not in ("ul", "ol", "div", "table") or not x.text_len or x.link_len <= 0.6 * x.text_len:
        return False
    return x.link_len < 25 * max(x.links, 1)


def _blocks(x: Node, prose: bool = False) -> list[str]:
    """The blocks of an element; prose: whether some stands before it already."""
    out, cur = [], []

    def flush() -> None:
        nonlocal prose
        t = _SPACE.sub(" ", unescape("".join(cur))).strip()
        if t:
            out.append(t)
            prose = prose or len(t) >= PROSE
        cur.clear()

    stack: list = [x]
    while stack:
        c = stack.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            cur.append(c)
        elif c.tag == "br":
            cur.append(" ")
        elif c.drop == "skip":
            continue
        elif c is not x and (c.drop or not prose and _menu(c)):
            if c.tag not in INLINE:
                flush()
        else:
            block = c.tag not in INLINE and c.tag not in VOID
            if block or c.tag == "hr":
                flush()
                stack.append(None)
            stack.extend(reversed(c.children))
    flush()
    return out


def main_text(html: str) -> str:
    """The main text: blocks joined by two line feeds ("" for an empty page or one without text)."""
    root = parse(html)
    total = _judge(root, True)
    text = _main(root)
    if len(text) < 0.1 * total and len(text) < 200:  # almost nothing is left: names and tags of furniture do not count
        _judge(root, False)
        text = max(text, _main(root), key=len)
    return text


def _main(root: Node) -> str:
    order = _measure(root)
    held = [x for x in order if x.points > 0 and x.tag not in INLINE]
    if not held:  # no paragraph at all: the element article or main, or else the whole page
        best = next((x for x in order if x.tag in ("article", "main")), root)
        return "\n\n".join(_blocks(best))
    best = max(held, key=_score)  # the first of equals
    up = best
    while up is not None:  # an article or main element around it is the article
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    top = _score(best)
    keep = [best]
    if best.parent is not None and best.tag not in ("main", "body"):
        keep = []
        for s in best.parent.children:
            if s is best:
                keep.append(s)
            elif best.tag == "article":  # of its siblings, only other articles of some weight
                if isinstance(s, Node) and s.tag == "article" and not s.drop and s.points > 0.2 * best.points:
                    keep.append(s)
            elif isinstance(s, Node) and not s.drop:
                links = s.link_len / s.text_len if s.text_len else 0
                prose = s.tag == "header" or s.tag in PARAGRAPH and (s.tag in HEADING or s.text_len > 80 and links < 0.25 or 0 < s.text_len and links == 0)
                if _score(s) > max(2.0, top * 0.2) or prose and links < 0.5:
                    keep.append(s)
    out: list[str] = []
    prose = False
    for x in keep:
        out += (more := _blocks(x, prose))
        prose = prose or any(len(t) >= PROSE for t in more)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text. Null or empty html: an empty text. Other columns are ignored;
    null ids and urls stay null, repeated rows give repeated results, no pages give no row. A page of any length is read
    whole, in time that grows with its length; of containers with equal scores, the first one is taken."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                text = [main_text(h.as_py() or "") for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    cols = pages.select("page_id", "url", "html")
    return cols.mapInArrow(run, f"page_id {cols.schema['page_id'].dataType.simpleString()}, url string, text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


SQL: dict[str, str] = {}
