"""Main text of web pages by composite text density.

Every element gets a density: its characters per tag, adjusted by how much of its text and how many of its tags are
links. The densest element and its path from the body give the threshold (the least density on the path); of the elements
at or above it, the one whose children's densities sum highest is the main subtree. Elements that are boilerplate
by name, role, class or id are cut out before densities are taken, forms, dialogs and those by class or id only where they do
not hold the page's content, and an article or main element around the chosen subtree is taken whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|(?<![\w-])(hidden)(?![\w-])")
#: Markup that needs no end, where no > follows.
OPEN_END = re.compile(r"<!--|<!\[CDATA\[|<[!?]")
PART = re.compile(r"[-_]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Start tag -> open elements that it ends, and those that stop the search.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
BOILERPLATE_TAGS = frozenset(
    "head nav header footer aside script style noscript template iframe svg canvas math button select option datalist input textarea"
    " object embed audio video menu noembed noframes xmp title".split()
)
#: Boilerplate unless the page's content stands in it, as with a form around the whole page.
WRAPPERS = frozenset(("form", "dialog"))
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login"
    " masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related respond"
    " share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: In a class such as has-sidebar the name says what the element has or lacks, not what it is.
QUALIFIERS = frozenset("has have with without no not non is hide hides show shows".split())
WHOLE = frozenset(("article", "main"))
#: Start tags that may stand in a head; any other, and text, ends it.
HEAD_TAGS = frozenset("head html base basefont bgsound link meta title script style noscript noframes template".split())


class Node:
    __slots__ = ("tag", "parent", "end", "chars", "tags", "link_chars", "link_tags", "density", "density_sum", "in_link", "named")

    def __init__(self, tag: str, parent: int, in_link: bool, named: bool = False):
        self.tag, self.parent, self.in_link, self.end = tag, parent, in_link, 0
        self.named = named  # boilerplate by class or id, or a form or dialog
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = 0.0


class Page(NamedTuple):
    nodes: list[Node]  # in page order; a subtree is nodes[i : nodes[i].end]
    texts: list[tuple[int, str]]  # (node, text); a break between blocks is a space


def _named(value: str) -> bool:
    """Does a class or id name boilerplate: as a whole, or as the last word of a compound (site-footer, but not footer-less)."""
    for token in value.split():
        parts = PART.split(token)
        if token in BOILERPLATE_NAMES or parts[-1] in BOILERPLATE_NAMES and QUALIFIERS.isdisjoint(parts):
            return True
    return False


def _boilerplate(tag: str, attributes: str) -> tuple[bool, bool]:
    """Is an element boilerplate for certain, and is it unless it holds the content: by class or id, or as a form or dialog."""
    if tag in BOILERPLATE_TAGS:
        return True, False
    named = tag in WRAPPERS
    if "=" not in attributes and "hidden" not in attributes:
        return False, named
    for name, *values, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if hidden or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, False
        if name == "role" and value in BOILERPLATE_ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("html", "body", "main") and _named(value):
            named = True
    return False, named


def _without_named(page: Page) -> Page:
    """The page without forms, dialogs and elements that are boilerplate by class or id, unless they hold its content: a main
    or article element that is not such itself, or most of the text where no main or article stands elsewhere."""
    nodes, texts = page
    chars = [0] * (len(nodes) + 1)  # running sum over nodes in page order
    for node, text in texts:
        chars[node + 1] += len(" ".join(text.split()))
    content = [0] * (len(nodes) + 1)
    for i, node in enumerate(nodes):
        chars[i + 1] += chars[i]
        content[i + 1] = content[i] + (node.tag in WHOLE and not node.named)
    number, kept, i = [-1] * len(nodes), [], 0
    while i < len(nodes):
        node = nodes[i]
        most = not content[-1] and 2 * (chars[node.end] - chars[i]) > chars[-1]
        if node.named and content[node.end] == content[i] and not most:
            i = node.end
            continue
        number[i] = len(kept)
        kept.append(node)
        i += 1
    upto = [0]
    for n in number:
        upto.append(upto[-1] + (n >= 0))
    for node in kept:
        node.parent, node.end = number[node.parent] if node.parent >= 0 else -1, upto[node.end]
    return Page(kept, [(number[node], text) for node, text in texts if number[node] >= 0])


def parse(source: str) -> Page:
    """Elements and texts of a page without its boilerplate. Broken markup is mended as browsers do in the usual cases."""
    nodes, texts = [Node("#root", -1, False)], []
    stack = [("#root", 0)]  # (tag, node, or -1 inside boilerplate)
    open_tags = Counter()  # how often each tag is on the stack, so that a tag without a partner costs nothing
    at, end, searched = 0, len(source), MARKUP.search
    last = source.rfind(">") + 1  # no tag ends behind it

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag, node = stack.pop()
            open_tags[tag] -= 1
            if node > 0:
                nodes[node].end = len(nodes)
            if tag not in INLINE and stack[-1][1] >= 0:
                texts.append((stack[-1][1], " "))

    while at < end:
        found = searched(source, at, last) if at < last else None
        rest = None if found else OPEN_END.search(source, at)
        stop = found.start() if found else rest.start() if rest else end
        if stack[-1][0] == "head" and source[at:stop].strip():
            close(len(stack) - 1)
        if stop > at and stack[-1][1] >= 0:
            texts.append((stack[-1][1], html.unescape(source[at:stop])))
        if not found:
            if rest and rest.group() == "<![CDATA[" and stack[-1][1] >= 0:
                texts.append((stack[-1][1], source[rest.end() :]))
            break
        at = found.end()
        slash, tag, attributes = found.groups()
        if tag is None:
            markup = found.group()
            # a comment or section that is still open where the last tag ends goes on to the end
            if at == last and (markup.startswith("<!--") and not markup.endswith("-->") or markup.startswith("<![CDATA[") and not markup.endswith("]]>")):
                markup, at = source[found.start() :], end
            if markup.startswith("<![CDATA[") and stack[-1][1] >= 0:
                texts.append((stack[-1][1], markup[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if slash:
            for depth in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if open_tags["head"] and (tag == "body" or stack[-1][0] == "head" and tag not in HEAD_TAGS):
            for depth in range(1, len(stack)):
                if stack[depth][0] == "head":
                    close(depth)
                    break
        if tag in CLOSES_P and open_tags["p"]:
            depth = len(stack) - 1
            while stack[depth][0] in INLINE:
                depth -= 1
            if stack[depth][0] == "p":
                close(depth)
        elif tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1) if any(open_tags[t] for t in ends) else ():
                if stack[depth][0] in bounds:
                    break
                if stack[depth][0] in ends:
                    close(depth)
                    break
        top = stack[-1][1]
        if top >= 0 and tag not in INLINE:
            texts.append((top, " "))
        if tag in VOID:
            if top >= 0:
                nodes[top].tags += 1
            continue
        node = -1
        cut, named = _boilerplate(tag, attributes) if top >= 0 else (True, False)
        if not cut:
            node = len(nodes)
            nodes.append(Node(tag, top, tag == "a" or nodes[top].in_link, named))
        if tag in RAW:
            close_tag = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if node >= 0:
                texts.append((node, html.unescape(source[at : close_tag.start() if close_tag else end])))
                nodes[node].end = len(nodes)
            at = close_tag.end() if close_tag else end
        elif not attributes.endswith("/>") or tag in INLINE or tag in CLOSES_P:
            stack.append((tag, node))
            open_tags[tag] += 1
        elif node >= 0:
            nodes[node].end = len(nodes)
    close(1)
    nodes[0].end = len(nodes)
    page = Page(nodes, texts)
    return _without_named(page) if any(node.named for node in nodes) else page


def _measure(page: Page) -> int:
    """Fills in counts, densities and sums of densities; returns the body's number."""
    nodes = page.nodes
    for number, text in page.texts:
        n = len(" ".join(text.split()))
        nodes[number].chars += n
        if nodes[number].in_link:
            nodes[number].link_chars += n
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.chars += node.chars
        up.tags += node.tags + 1
        up.link_chars += node.link_chars
        up.link_tags += node.link_tags + (node.tag == "a")
    body = next((i for i, node in enumerate(nodes) if node.tag == "body"), 0)
    whole = nodes[body]
    linked = whole.link_chars / whole.chars if whole.chars else 0.0
    for node in nodes:
        node.density = _density(node, linked)
    for node in nodes[1:]:
        nodes[node.parent].density_sum += node.density
    return body


def _density(node: Node, linked: float) -> float:
    """Characters per tag times a logarithm that falls as links take over the element."""
    chars, tags = node.chars, max(1, node.tags)
    if not chars:
        return 0.0
    plain = max(1, chars - node.link_chars)
    base = math.log(chars / plain * node.link_chars + linked * chars + math.e)
    if base <= 1:  # no link in the element, nor in the page
        return chars / tags
    ratio = chars / max(1, node.link_chars) * (tags / max(1, node.link_tags))
    return chars / tags * max(0.0, math.log(max(1.0, ratio)) / math.log(base))


def main_subtree(page: Page) -> int:
    """The number of the element that holds the main text."""
    nodes, body = page.nodes, _measure(page)
    inside = range(body, nodes[body].end)
    densest = max(inside, key=lambda i: nodes[i].density)
    threshold, step = nodes[body].density, densest
    while step > body:
        threshold, step = min(threshold, nodes[step].density), nodes[step].parent
    best = max((i for i in inside if nodes[i].density >= threshold), key=lambda i: nodes[i].density_sum, default=body)
    step = best
    while step > body:
        if nodes[step].tag in WHOLE:
            best = step
        step = nodes[step].parent
    return best


def main_text(source: str | None) -> str:
    """The main text of one page; empty for null, empty or text-free pages."""
    if not source:
        return ""
    page = parse(source)
    first = main_subtree(page)
    last = page.nodes[first].end
    return " ".join("".join(text for node, text in page.texts if first <= node < last).split())


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): the main text of the whole html of every page.

    A null or empty html gives an empty text. Repeated rows and null ids stay, other columns are ignored, an empty table
    gives no rows. Very long and broken pages are read whole, in time that grows with their length. Of elements with equal
    sums the first in page order is taken.
    """

    def extract(batches):
        for batch in batches:
            texts = [main_text(source) for source in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", F.col("html")).mapInArrow(extract, f"{kinds}, text string, n_chars long")
