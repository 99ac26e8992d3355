"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: Elements that are never text of an article.
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select textarea input iframe object embed svg canvas audio video dialog menu".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text passes points to their ancestors.
SCORED = frozenset("p pre blockquote td dd li h2 h3 h4".split())
#: Elements of plain text that stay beside the best container.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
#: A start tag that ends an open element of these names, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Words in an element's class or id, which are told apart at signs and digits. Reader comments always go;
#: furniture goes unless another of the element's words says content; loose furniture also stays where
#: one word says both, as in post-header.
COMMENT = re.compile(r"(?:^|[_-])(?:comments?|disqus|replies|respond)(?:$|[_-]|\d)", re.I)
FIRM = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|breadcrumbs?|consent|cookies?|footer|gdpr|menu|modal|nav\w*|newsletter|pagination|popup|related|sidebar|sponsor\w*|subscribe|toolbar)(?:$|[_-]|\d)", re.I)
LOOSE = re.compile(r"(?:^|[_-])(?:alert|banner|form|header|masthead|notices?|promo\w*|share|sharing|social)(?:$|[_-]|\d)", re.I)
CONTENT = re.compile(r"(?:^|[_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[_-]|\d)", re.I)
#: What may stand beside furniture in one word without naming a subject, as it does in related-work.
PLACE = frozenset("area articles bar block bottom box button buttons col container fixed global group icons inner item items js left links list mobile outer overlay panel posts right row section site slot sticky stories top unit widget wrap wrapper".split())
PARTS = re.compile(r"[^\W\d_]+")
#: Furniture that names a subject goes if half of its text is links, or if it has less text than this and
#: is no paragraph, heading or the like.
SHORT = 100
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
#: End tags that close elements outside the table or cell they stand in.
THROUGH = frozenset("table tr tbody div article body".split())
CELLS = frozenset(("td", "th", "table"))
NAME = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)")
#: A tag as most are. It holds no other <, so that trying it everywhere takes linear time.
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)([^<>\"']*+(?:(?:\"[^\"<]*\"|'[^'<]*')[^<>\"']*+)*+)>")
SPECIAL = re.compile(r"[>\"']")
#: One attribute with its value, so that nothing is looked for inside values.
ATTRIBUTE = re.compile(r"([^\s=/<>\"']+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOLD = frozenset("class id role hidden aria-hidden".split())
SPACES = re.compile(r"\s+")


class Node:
    """An element: its children are nodes and strings. ``nested``: an article or main part is around it."""

    __slots__ = ("attrs", "children", "furniture", "links", "name", "parent", "score", "size")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None, nested: bool = False):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []
        self.score, self.size, self.links = 0.0, 0, 0
        self.furniture = parent is not None and self._furniture(nested)

    def _furniture(self, nested: bool) -> bool | None:
        """None: by what its words say it may be, and its text must tell."""
        a, name = self.attrs, self.name
        if name in DROPPED and not (name == "header" and nested):
            return True
        if not a:
            return False
        if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
            return True
        words = self.words()
        if not words or name in ("html", "body", "article", "main"):
            return False
        if any(COMMENT.search(w) for w in words):
            return True
        content = [w for w in words if CONTENT.search(w)]
        if any(not FIRM.search(w) and not LOOSE.search(w) for w in content):
            return False
        if name in HEADING:  # its id names what it is about
            words = a.get("class", "").split()
        odd = [w for w in words if FIRM.search(w) or (LOOSE.search(w) and w not in content)]
        if any(not _names_subject(w) for w in odd):
            return True
        return None if odd else False

    def words(self) -> list[str]:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".split()


def _names_subject(word: str) -> bool:
    """Whether a word of furniture says something besides, or is form or header alone, which articles have too."""
    parts = PARTS.findall(word.lower())
    other = [x for x in parts if not FIRM.search(x) and not LOOSE.search(x)]
    return parts in (["form"], ["header"]) or any(x not in PLACE and not CONTENT.search(x) for x in other)


class TagEnds:
    """Finds the ends of tags in one page in time linear in its length, whatever stands in it.

    A scan outside quotes only depends on where it is. What a failed scan has seen outside quotes is
    remembered, and so is the way to the next special character.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.clear = (0, 0)
        self.failed: set[int] = set()

    def _special(self, at: int) -> int:
        lo, hi = self.clear
        if not lo <= at <= hi:
            m = SPECIAL.search(self.html, at)
            self.clear = lo, hi = at, m.start() if m else len(self.html)
        return hi

    def find(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes start at ``at``; -1 if it is no tag."""
        seen = []
        while at <= self.last:
            at = self._special(at)
            if at in self.failed or at > self.last:
                break
            if (c := self.html[at]) == ">":
                return at
            seen.append(at)
            if (close := self.html.find(c, at + 1)) < 0:
                break
            at = close + 1
        self.failed.update(seen)
        return -1


class Open:
    """The elements that are open, and where each name, each block and each cell is among them."""

    def __init__(self):
        self.stack = [Node("#root", {}, None)]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks, self.cells = [0], [0]

    def deepest(self, names) -> int:
        """Place of the innermost open element of these names; 0 without one."""
        at = self.at
        return max([at[n][-1] for n in names if n in at and at[n]], default=0)

    def push(self, node: Node) -> None:
        name, depth = node.name, len(self.stack)
        self.at[name].append(depth)
        if name in BLOCK:
            self.blocks.append(depth)
            if name in CELLS:
                self.cells.append(depth)
        self.stack.append(node)

    def cut(self, to: int) -> None:
        """Closes the element at place ``to`` and all inside it."""
        stack, at = self.stack, self.at
        while len(stack) > to:
            at[stack.pop().name].pop()
        for marks in (self.blocks, self.cells):
            while marks[-1] >= to:
                marks.pop()

    def end(self, name: str) -> None:
        """An end tag closes the innermost element of its name; most can't leave a table or cell."""
        if (places := self.at.get(name)) and (places[-1] >= self.cells[-1] or name in THROUGH):
            self.cut(places[-1])

    def begin(self, name: str) -> None:
        """Closes what a start tag ends."""
        if name in ENDS_P and (at := self.blocks[-1]) and self.stack[at].name == "p":
            self.cut(at)
        if name in ENDS:
            closed, bounds = ENDS[name]
            if (at := self.deepest(closed)) > self.deepest(bounds):
                self.cut(at)


def parsed(html: str) -> Node:
    """The tree of a page; unclosed and misnested elements are closed as browsers mostly do."""
    open_, ends = Open(), TagEnds(html)
    root = open_.stack[0]
    text = pos = 0  # text that is not in the tree yet; where to look next

    def flush(upto: int) -> None:
        if upto > text:
            open_.stack[-1].children.append(unescape(html[text:upto]))

    while (at := html.find("<", pos)) >= 0:
        if tag := PLAIN_TAG.match(html, at):
            end, inside = tag.end() - 1, tag[3]
        elif tag := NAME.match(html, at):
            if (end := ends.find(tag.end())) < 0:
                pos = tag.end()
                continue
            inside = html[tag.end() : end]
        elif html.startswith(("<!", "<?"), at):
            close, first = ("-->", 4) if html.startswith("<!--", at) else (">", 2)
            flush(at)
            end = html.find(close, at + first)
            text = pos = len(html) if end < 0 else end + len(close)
            continue
        else:
            pos = at + 1
            continue
        flush(at)
        text = pos = end + 1
        name = tag[2].lower()
        if tag[1]:
            open_.end(name)
            continue
        open_.begin(name)
        attrs = {n: x or y or z for k, x, y, z in ATTRIBUTE.findall(inside) if (n := k.lower()) in TOLD} if len(inside) > 4 else {}
        around = open_.stack[-1]
        node = Node(name, attrs, around, name == "header" and open_.deepest(("article", "main")) > 0)
        around.children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b", re.I).search(html, pos)
            end = html.find(">", close.end()) if close else -1
            text = pos = len(html) if end < 0 else end + 1
        elif name not in VOID and not inside.endswith("/"):
            open_.push(node)
    flush(len(html))
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes outside furniture, parents first, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.furniture:
            continue
        out.append(node)
        stack += [x for x in reversed(node.children) if isinstance(x, Node)]
    return out


def _measured(root: Node) -> list[Node]:
    """All nodes outside furniture with their size (code points of text) and links (those in links)."""
    nodes = _nodes(root)
    for node in nodes:
        own = sum(len(SPACES.sub(" ", x).strip()) for x in node.children if not isinstance(x, Node))
        node.size, node.links, node.score = own, 0, 0.0
    for node in reversed(nodes):
        if node.name == "a":
            node.links = node.size
        if (up := node.parent) is not None:
            up.size += node.size
            up.links += node.links
    return nodes


def scored(root: Node) -> list[Node]:
    """Sets size, links and score of all nodes outside furniture.

    A text element passes 1 point, 1 for each comma and 1 for each 100 code points, 3 at most, whole
    to its parent, half to its parent's parent and a third of that per further level; each element's
    sum is discounted by its link density.
    """
    nodes = _measured(root)
    if doubtful := [x for x in nodes if x.furniture is None]:
        for x in doubtful:
            x.furniture = 2 * x.links >= max(x.size, 1) or (x.size < SHORT and x.name not in PLAIN and x.name not in SCORED)
        if any(x.furniture for x in doubtful):
            nodes = _measured(root)
    for node in nodes:
        if node.name in ("article", "main"):
            node.score += 10
        elif node.attrs and any(CONTENT.search(w) for w in node.words()):
            node.score += 5
        if node.name in SCORED and node.size >= 25:
            commas = sum(x.count(",") for x in node.children if not isinstance(x, Node)) + sum(y.count(",") for x in node.children if isinstance(x, Node) for y in x.children if not isinstance(y, Node))
            points, up, level = 1 + commas + min(node.size // 100, 3), node.parent, 1.0
            while up is not None and level > 0.01:
                up.score += points * level
                up, level = up.parent, level / (2 if level == 1 else 3)
    for node in nodes:
        node.score *= 1 - node.links / max(node.size, 1)
    return nodes


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Appends the texts of a subtree, a list of parts for each block. No recursion: pages can be deep."""
    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif x.furniture:
            continue
        elif x.name == "br":
            out[-1].append(" ")
        else:
            edge = [None] if x.name in BLOCK else []
            stack += [*edge, *reversed(x.children), *edge]


def main_text(html: str | None) -> str:
    """The article of a page as blocks joined by newlines; empty for pages without text.

    The best container, or the article around it, is kept, with those of its siblings that score a
    fifth as much; beside a container that is no article, plain text elements with few links stay too.
    White space inside a block is one space.
    """
    if not html:
        return ""
    root = parsed(html)
    nodes = scored(root)
    best = at = max(nodes, key=lambda n: n.score)
    while at is not None:  # an article around the best container is it
        if at.name in ("article", "main") and 2 * at.links < at.size:
            best = at
            break
        at = at.parent
    keep = [best]
    if best.parent is not None and best.name not in ("body", "html") and best.score > 0:
        beside = PLAIN if best.name not in ("article", "main") else frozenset()
        least = max(10.0, best.score * 0.2)
        keep = [x for x in best.parent.children if isinstance(x, Node) and not x.furniture and (x is best or x.score >= least or (x.name in beside and 3 * x.links < x.size))]
    out: list[list[str]] = [[]]
    for x in keep:
        out.append([])
        _blocks(x, out)
    blocks = (SPACES.sub(" ", "".join(parts)).strip() for parts in out)
    return "\n".join(b for b in blocks if b)


@F.pandas_udf(T.StringType())
def _main_texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([main_text(x) for x in batch], dtype=object)


def with_main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """pages with the column ``name``: the main text; null and empty pages have an empty one. A column
    of that name is replaced, all others stay, whatever their names. Whole pages are read, in time linear
    in their length. Equal pages, repeated rows among them, have equal texts; of containers that tie the
    first in the page is the best. An empty table stays one."""
    return pages.withColumn(name, _main_texts(c.text_or_empty(html)))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of pages, repeated ones each; null and empty pages have an empty one."""
    pages = c.read_columns(spark, sf_dir, "pages", "page_id", "url", "html")
    return with_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
