"""Main text of web pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import ready_workers

#: Fixed by HTML: elements without content, elements whose content is no markup, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead "
    "tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that end an open paragraph, and elements that one doesn't reach across.
ENDS_P = BLOCKS - frozenset("br td th tr tbody thead tfoot caption html body legend".split())
#: Open elements that a start tag of the same kind ends: by kind, the tags that do, those ended, and where the reach stops.
KINDS = (
    (ENDS_P, frozenset({"p"}), frozenset("article div section td th li body main".split())),
    (frozenset({"li"}), frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"tr"}), frozenset({"tr", "td", "th"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), frozenset({"tr", "table"})),
    (frozenset({"option"}), frozenset({"option"}), frozenset({"select"})),
)
#: Elements that are never shown as text, and those that never hold main text.
UNSEEN = frozenset("head title script style template noscript iframe svg canvas object xmp textarea select option dialog".split())
DROPPED = UNSEEN | frozenset("nav header footer aside form button input menu search label fieldset".split())
#: Roles that mark the same.
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words in a class or id that speak for furniture. They only weigh what is in the element: see WEIGHT.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar header footer masthead cookie cookies consent notice notices popup modal newsletter subscribe share sharing social related "
    "recommended comment comments reply replies disqus respond pagination pager widget skip login signup copyright disclaimer toolbar".split()
)
#: What may be written on to one of them without another meaning, as in cookiebar or commentlist.
ENDINGS = ("s", "list", "section", "box", "bar", "area", "block", "container", "wrap", "wrapper", "form", "thread", "banner", "panel", "menu")
COMPOUNDS = FURNITURE | {w + e for w in FURNITURE if len(w) > 2 for e in ENDINGS} | {"adbox", "adbanner", "adblock", "adslot", "topbar"}
#: Words that turn a name into a statement about a page's state, as in has-sidebar or comments-open.
STATES = frozenset("no not non has have with without is off on open opened closed enabled disabled hide hidden show shown visible full".split())
#: Names of the article itself: alone they speak for it, and before a header they make it the article's own.
ARTICLE = frozenset("article post entry hentry content story main body text".split())
#: Least share of link text, least number of links, and mean characters of a link's label at most, of a
#: block in the article that is a menu.
MENU_SHARE, MENU_LINKS, MENU_LABEL = 0.8, 3, 24
#: What densities count for inside an element whose class or id speaks for furniture.
WEIGHT = 0.1

#: The rest of a tag after its name: quotes count only where a value begins, and nothing is looked at twice.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute after the other, values consumed: name, and its value in one of three forms.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLANK = re.compile(r"\s+")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Node:
    """An element: what is directly in it, and sums over its subtree."""

    __slots__ = ("chars", "children", "density", "doubtful", "dropped", "framed", "link_chars", "links", "open", "parent", "sum", "sure", "tag", "tags", "unseen", "weight")

    def __init__(self, tag: str, parent: Node | None, sure: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.sure, self.doubtful = tag, parent, sure, doubtful
        self.dropped, self.weight = sure, 1.0
        self.framed = tag in ("article", "main") or (parent is not None and parent.framed)
        self.unseen = tag in UNSEEN
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.sum = 0.0
        #: By kind, the outermost open element that a tag of the kind ends here.
        self.open: tuple[Node | None, ...] = parent.open if parent else (None,) * len(KINDS)
        if tag in SCOPED:
            self.open = tuple(
                (was or self) if tag in ended else None if tag in stops else was for was, (_, ended, stops) in zip(self.open, KINDS, strict=True)
            )

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


SCOPED = frozenset().union(*(ended | stops for _, ended, stops in KINDS))


def furniture_name(value: str) -> bool:
    """Whether a class or id speaks for furniture."""
    names = [[w.lower() for w in WORDS.findall(name)] for name in value.split()]
    if any(len(words) == 1 and words[0] in ARTICLE for words in names):
        return False
    for words in names:
        own_header = words and words[0] in ARTICLE and words[-1] in ("header", "banner", "related", "social")
        if not own_header and STATES.isdisjoint(words) and not COMPOUNDS.isdisjoint(words):
            return True
    return False


def unwanted(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is furniture by its name, role or hidden, and whether its class or id speaks for that."""
    if tag in DROPPED:
        return True, False
    if len(attributes) < 3 or tag in ("html", "body"):
        return False, False
    named = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role":
            if value.strip().lower() in DROPPED_ROLES:
                return True, False
        elif name == "hidden":
            return True, False
        elif name in ("class", "id") and not named and tag not in ("article", "main") and tag not in HEADINGS:
            named = furniture_name(value)
    return False, named


def parse(page: str) -> Node:
    """A tree of the page, in one pass. Tags that are never closed, or closed out of turn, are put right
    as far as a reader would: blocks end paragraphs, items end items, an end tag ends all that is open
    in its element, and one without an open element is passed over. A tag without an end is text."""
    root = Node("#root", None)
    here, at, end = root, 0, len(page)
    count: dict[str, int] = {}

    def up_to(node: Node | None) -> Node:
        """Close what is open inside node."""
        x = here
        while x is not node:
            count[x.tag] -= 1
            x = x.parent
        return x

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            here.children.append(page[at:])
            break
        mark = page[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            if lt > at:
                here.children.append(page[at:lt])
            close = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            stop = page.find(close, lt + (4 if close == "-->" else 2))
            at = end if stop < 0 else stop + len(close)
            continue
        ends = mark == "/"
        name = NAME.match(page, lt + 1 + ends)
        if name is None:
            here.children.append(page[at : lt + 1])
            at = lt + 1
            continue
        rest = REST.match(page, name.end())
        if rest is None:
            here.children.append(page[at:])
            break
        if lt > at:
            here.children.append(page[at:lt])
        at = rest.end()
        tag = name[0].lower()
        if ends:
            if count.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                here = up_to(node.parent)
            continue
        for kind, (starts, _, _) in enumerate(KINDS):
            if tag in starts and here.open[kind] is not None:
                here = up_to(here.open[kind].parent)
        attributes = page[name.end() : at - 1]
        sure, doubtful = unwanted(tag, attributes)
        made = Node(tag, here, sure and not (tag == "header" and here.framed), doubtful)
        made.unseen = made.unseen or here.unseen
        here.children.append(made)
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not attributes.endswith("/"):
            here = made
            count[tag] = count.get(tag, 0) + 1
    return root


def in_order(root: Node) -> list[Node]:
    """All nodes that are shown, parents first, in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.unseen)
    return order


def counted(order: list[Node]) -> None:
    """Characters, tags, link characters and links of all nodes, children before parents."""
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c) - c.count(" ") - c.count("\n")
            elif not c.unseen:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.links += c.links
        if node.tag == "a":
            node.link_chars, node.links = node.chars, node.links + 1


def measured(root: Node) -> list[Node]:
    """All nodes that are shown, with their characters, tags, link characters, links and composite density.

    Composite density: characters a tag, times the logarithm of (chars / link chars * tags / links) to
    the base ln(chars / other chars * link chars + page's link share * chars + e); counts of none are
    one. So a node of mostly links has next to none.
    """
    order = in_order(root)
    counted(order)
    page_share = root.link_chars / root.chars if root.chars else 0.0
    for node in order:
        if node.chars:
            node.density = composite_density(node.chars, node.tags, node.link_chars, node.links, page_share)
    return order


def composite_density(chars: int, tags: int, link_chars: int, links: int, page_share: float) -> float:
    tags, links, linked, plain = max(tags, 1), max(links, 1), max(link_chars, 1), max(chars - link_chars, 1)
    base = math.log(chars / plain * linked + page_share * chars + math.e)
    return chars / tags * max(0.0, math.log(max(chars / linked * tags / links, 1.0)) / math.log(base))


def settle(order: list[Node]) -> None:
    """Drop what is furniture by its element or role, and all in it. Such an element with most of the
    page's text, and no more than half of that in links, is a wrapper and stays. Names only weigh."""
    root = order[0]
    if not root.chars:
        counted(order)
    for node in order:
        up = node.parent
        wrapper = 2 * node.chars > root.chars and 2 * node.link_chars <= node.chars
        node.dropped = (node.sure and not wrapper) or (up is not None and up.dropped)
        node.weight = WEIGHT if node.doubtful or (up is not None and up.weight < 1) else 1.0


def selected(root: Node) -> tuple[list[Node], float]:
    """The subtrees that hold the main text, in page order, and the threshold.

    The kept node with the largest sum of its kept children's weighted densities (one without children:
    its own) is the core. The threshold is the least density on the path from the body to it, without
    weights. Beside that path every kept node whose weighted density reaches the threshold gives its
    own largest-sum node, and its other nodes are looked at in the same way. Of equal sums the
    outermost and first node counts.
    """
    order = measured(root)
    settle(order)
    best_in: dict[int, Node] = {}
    for node in reversed(order):
        if node.dropped:
            continue
        inside = [c for c in node.elements() if not c.dropped and not c.unseen and c.tag not in VOID]
        node.sum = sum(c.density * c.weight for c in inside) if inside else node.density * node.weight
        best = node
        for c in inside:
            if best_in[id(c)].sum > best.sum:
                best = best_in[id(c)]
        best_in[id(node)] = best
    core = best_in[id(root)]
    path, node = set(), core
    threshold = math.inf
    while node is not None:
        path.add(id(node))
        if node.tag not in ("#root", "html") and node.density > 0:
            threshold = min(threshold, node.density)
        node = node.parent
    found, todo = [], [root]
    chosen = {id(core)}
    while todo:
        node = todo.pop()
        if id(node) in chosen:
            found.append(node)
            continue
        for c in reversed(node.children):
            if isinstance(c, Node) and not c.dropped and c.chars and (id(c) in path or c.density * c.weight >= threshold):
                if id(c) not in path:
                    best = best_in[id(c)]
                    chosen.add(id(best))
                    while best is not node:
                        path.add(id(best))
                        best = best.parent
                todo.append(c)
    return found, threshold


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order; see selected()."""
    return selected(root)[0]


def is_menu(node: Node) -> bool:
    """Whether a block is a list of links with short labels: nearly all of its text is, and there are several.
    A list of linked references, whose labels are long, is none."""
    return node.tag in BLOCKS and node.links >= MENU_LINKS and node.link_chars >= MENU_SHARE * node.chars and node.link_chars < MENU_LABEL * node.links


def left_out(part: Node, node: Node, threshold: float) -> bool:
    """Whether a part of the main text's node is none of it: a menu, or an element whose name speaks for
    furniture, with no more than half of the node's text and a weighted density below the threshold."""
    return is_menu(part) or (part.doubtful and 2 * part.chars <= node.chars and part.density * WEIGHT < threshold)


def blocks_of(node: Node, threshold: float, out: list[list[str]]) -> None:
    """Texts of each block of a subtree in page order; a new block begins at block elements."""
    out.append([])
    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not x.dropped and not x.unseen and not (x is not node and left_out(x, node, threshold)):
            edge = x.tag in BLOCKS
            if edge:
                out.append([])
                todo.append(None)
            todo.extend(reversed(x.children))


def main_text(page: str | None) -> str:
    """Main text of a page: blocks in page order joined by one space, each with character references
    decoded, white space as one space, and trimmed. Null and empty pages have none."""
    if not page:
        return ""
    found: list[list[str]] = []
    nodes, threshold = selected(parse(page))
    for node in nodes:
        blocks_of(node, threshold, found)
    texts = []
    for parts in found:
        text = BLANK.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            texts.append(text)
    return " ".join(texts)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    pages: page_id, url, html; other columns are ignored. Returns a row for each row: page_id, url,
    text (empty if there is none), n_chars (code points). Null html is an empty page; html without
    markup is its own text; repeated rows and null ids get a row each; an empty table gives none.
    Nothing moves between tasks.
    """
    ready_workers(pages.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    schema = pages.schema
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {schema['page_id'].dataType.simpleString()}, url {schema['url'].dataType.simpleString()}, text string, n_chars long"
    )
