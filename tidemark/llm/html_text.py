"""Main text of HTML pages by tag-path ratios.

A page is scanned once into blocks: runs of text between block-level tags, each with its root-to-leaf path of tags and classes
(inline tags left out, as they are often not closed) and how much of it is links. Elements that HTML itself gives another
role than content (scripts, navigation, forms and so on), and hidden ones, make no blocks. Then

1. each path gets two ratios over its blocks: characters, and punctuation, per block, both without link text;
2. along the page, both are smoothed over neighbouring blocks with a Gaussian window, in which blocks of another parent
   count less, and averaged over each path again;
3. the two are fused by their product with a weight of the path: LANDMARK in an article or main element, less where an
   element is called what pages call adverts, comments or teasers;
4. paths of at least SHARE of the highest score are content. Blocks that are marked as something else never set the scale;
5. from the root down, an element's parts that hold content are followed into. Its other parts (tables, lists, short
   headings, say) belong to the text if the element is an article or holds content blocks itself, unless they are marked.
   Elsewhere only headings before content do.

So what an article holds stays whole, while the ratios say which elements are articles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import importable

# Tags by their role in HTML, and words by which pages name what isn't their article.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*>""", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "object", "canvas", "xmp"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track"}
BLOCKS = {"html", "body", "address", "article", "aside", "blockquote", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "img", "input", "col", "link", "meta", "base", "area", "embed", "param", "source", "track"}
SKIP = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "search"}
LEAVES = {"p", "li", "dt", "dd", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figcaption", "caption", "summary", "address"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
STRONG = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|sponsored|cookies?|consent|gdpr|popup|modal|sidebar|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|disqus|newsletter)(?:$|[-_\s\d])", re.I)
BOXES = re.compile(r"(?:^|[-_\s])(?:notices?|alert|banner|menu|promo|sponsor|overlay|subscribe|signup|login)(?:$|[-_\s\d])", re.I)  # as names of an element that holds others
WEAK = re.compile(r"(?:^|[-_\s])(?:promotion|widget|respond|replies|share|sharing|social|related|recommended|search|pagination|pager|toolbar|skip)(?:$|[-_\s\d])", re.I)
UNSAID = re.compile(r"\S*\b(?:has|with|no|without)[-_]\S+|\S+[-_](?:open|closed|enabled|disabled|none)(?!\S)", re.I)  # what a page has beside this element
MARKS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ATTRIBUTE = re.compile(r"""\b(?:hidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
SHARE, LINKS, SPAN, APART = 0.15, 0.6, 2, 0.05
LANDMARK, PLAIN, DOUBTFUL, OTHER = 10.0, 1.0, 0.5, 1e-3  # weights of a path
DEEPEST = 64  # block-level elements of a path; those further in are taken for the last of these


class Block:
    """path: names of the open elements; nodes: their numbers, by which equal names are told apart; weights: theirs."""

    __slots__ = ("path", "nodes", "weights", "text", "link")

    def __init__(self, path: tuple[str, ...], nodes: tuple[int, ...], weights: tuple[float, ...], text: str, link: int):
        self.path, self.nodes, self.weights, self.text, self.link = path, nodes, weights, text, link

    @property
    def weight(self) -> float:
        """Of the path: of a landmark, if there is one, and of the worst mark."""
        return max((*self.weights, PLAIN)) * min((*self.weights, PLAIN))

    def marked(self, depth: int = 0) -> float:
        """The worst mark of the elements from this depth on."""
        return min((*self.weights[depth:], PLAIN))

    @property
    def plain(self) -> int:
        """Characters beside links."""
        return max(0, len(self.text) - self.link)


def tag_of(name: str) -> str:
    return name.partition(".")[0]


def weighed(tag: str, attributes: str, parent: str) -> float:
    """What an element's tag, class, id or role says of its being content; a header of the page's body is the page's."""
    if tag in ("article", "main"):
        return LANDMARK
    if tag == "header" and parent in ("", "html", "body"):
        return OTHER
    if not attributes or tag in ("body", "html"):
        return PLAIN
    named = [UNSAID.sub("", "".join(m)) for m in MARKS.findall(attributes)]
    if any(map(STRONG.search, named)):
        return OTHER if tag not in HEADINGS else PLAIN
    if tag in LEAVES:
        return PLAIN
    return OTHER if any(map(BOXES.search, named)) else DOUBTFUL if any(map(WEAK.search, named)) else PLAIN


def blocks(html: str, forms: bool = False) -> list[Block]:
    """The blocks of a page in order, their character references decoded and white space made one space each; forms: theirs too."""
    found: list[Block] = []
    path: list[tuple[str, int, float]] = []  # open block-level elements, from the outermost on
    parts: list[str] = []
    link = in_link = skip = at = number = 0  # skip: depth of the outermost element that is left out, else 0

    def end() -> None:
        nonlocal link
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append(Block(*(zip(*path[:DEEPEST], strict=True) if path else ((), (), ())), text, link))
        parts.clear()
        link = 0

    def close(depth: int) -> None:
        nonlocal skip
        end()
        del path[depth:]
        if skip > len(path):
            skip = 0

    def told(text: str) -> None:
        nonlocal link
        if text and not skip:
            parts.append(text)
            if in_link:
                link += len(text)

    while m := TAG.search(html, at):
        told(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3]
        if tag in RAW:
            if not m[1] and not attributes.endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = shut.end() if shut else len(html)
            continue
        if tag in ("br", "wbr"):
            told(" " * (tag == "br"))
            continue
        if tag not in BLOCKS:  # inline, as is any element that HTML doesn't know
            if tag == "a":
                in_link = 0 if m[1] else 1
            if not m[1] and not skip and attributes and tag != "a" and ATTRIBUTE.search(attributes):
                shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = shut.end() if shut else at
            continue
        if m[1]:
            for depth in range(len(path) - 1, -1, -1):
                if tag_of(path[depth][0]) == tag:
                    close(depth)
                    in_link = 0
                    break
            continue
        end()
        if tag in VOID:
            continue
        if tag in CLOSES_P and path and tag_of(path[-1][0]) == "p":
            close(len(path) - 1)
        if tag in SIBLINGS:
            for depth in range(len(path) - 1, -1, -1):
                name = tag_of(path[depth][0])
                if name in SIBLINGS[tag]:
                    close(depth)
                elif name in ("ul", "ol", "dl", "table", "select") or tag == "p":
                    break
        if attributes.endswith("/") and tag not in ("p", "div"):
            continue
        named = CLASS.search(attributes)
        name = "".join(filter(None, named.groups())) if named else ""
        number += 1
        path.append((f"{tag}.{name}" if name else tag, number, weighed(tag, attributes, tag_of(path[-1][0]) if path else "")))
        if not skip and ((tag in SKIP and not (forms and tag == "form")) or ATTRIBUTE.search(attributes)) and tag not in ("html", "body"):
            skip = len(path)
    told(html[at:])
    end()
    return found


def smoothed(values: list[float], page: list[Block]) -> list[float]:
    """A Gaussian window over SPAN neighbours on either side, in which blocks of other parents count by APART."""
    weight = {d: exp(-d * d / 2) for d in range(-SPAN, SPAN + 1)}
    out = []
    for i, b in enumerate(page):
        total = over = 0.0
        for d, w in weight.items():
            if 0 <= i + d < len(page):
                if page[i + d].nodes[:-1] != b.nodes[:-1]:
                    w *= APART
                total, over = total + w * values[i + d], over + w
        out.append(total / over)
    return out


def scores(page: list[Block]) -> dict[tuple[str, ...], float]:
    """The fused ratios of each path."""
    paths: dict[tuple[str, ...], list[int]] = {}
    for i, b in enumerate(page):
        paths.setdefault(b.path, []).append(i)
    chars = [b.plain for b in page]
    marks = [len(PUNCTUATION.findall(b.text)) if b.link < LINKS * len(b.text) else 0 for b in page]
    ratios = []
    for per_block in (chars, marks):
        mean = {p: sum(per_block[i] for i in own) / len(own) for p, own in paths.items()}
        even = smoothed([mean[b.path] for b in page], page)
        ratios.append({p: sum(even[i] for i in own) / len(own) for p, own in paths.items()})
    return {p: ratios[0][p] * (1 + ratios[1][p]) * max(page[i].weight for i in own) for p, own in paths.items()}


def content_paths(page: list[Block]) -> set[tuple[str, ...]]:
    score = scores(page)
    best = max((score[b.path] for b in page if b.marked() != OTHER), default=0.0)
    linked: dict[tuple[str, ...], list[int]] = {}
    for b in page:
        own = linked.setdefault(b.path, [0, 0])
        own[0] += b.link
        own[1] += len(b.text)
    return {p for p, s in score.items() if best and s >= SHARE * best and linked[p][0] <= LINKS * linked[p][1]}


def main_blocks(page: list[Block]) -> list[str]:
    """The texts of the blocks that are content."""
    content = content_paths(page)
    hit = [b.path in content for b in page]
    before = [0, *accumulate(hit)]
    kept = [False] * len(page)

    def parts(i: int, j: int, depth: int) -> list[tuple[int, int]]:
        """Ranges of the blocks i to j - 1 that stand in the same child of the element at this depth, or right in it."""
        out = []
        for k in range(i, j):
            node = page[k].nodes[depth : depth + 1]
            if not out or not node or page[k - 1].nodes[depth : depth + 1] != node:
                out.append((k, k + 1))
            else:
                out[-1] = (out[-1][0], k + 1)
        return out

    def heading(i: int, j: int, depth: int) -> bool:
        return any(tag_of(x) in HEADINGS for x in page[i].path[depth:]) and page[i].path[depth] == page[j - 1].path[depth] if page[i].path[depth:] else False

    todo = [(0, len(page), 0)]
    while todo:
        i, j, depth = todo.pop()
        own = parts(i, j, depth)
        full = [before[b] > before[a] for a, b in own]
        if not any(full):
            continue
        element = tag_of(page[i].path[depth - 1]) if depth else ""
        direct = any(f and (len(page[a].nodes) == depth or (len(page[a].nodes) == depth + 1 and tag_of(page[a].path[depth]) in LEAVES)) for (a, b), f in zip(own, full, strict=True))
        first, last = full.index(True), len(full) - 1 - full[::-1].index(True)
        for n, ((a, b), f) in enumerate(zip(own, full, strict=True)):
            if f:
                if len(page[a].nodes) <= depth:
                    kept[a] = True
                else:
                    todo.append((a, b, depth + 1))
                continue
            if any(page[k].marked(depth) < PLAIN for k in range(a, b)):
                continue
            inside = first < n < last
            links = sum(page[k].link for k in range(a, b)) > LINKS * sum(len(page[k].text) for k in range(a, b))
            if element == "article":
                keep = True
            elif direct and element not in ("body", "html", ""):
                keep = inside or not links or heading(a, b, depth)
            elif direct:
                keep = inside or (n < first and heading(a, b, depth))
            else:
                keep = n < last and full[n + 1] and heading(a, b, depth)
            if keep:
                kept[a:b] = [True] * (b - a)
    return [b.text for b, k in zip(page, kept, strict=True) if k]


def extract(html: str | None) -> str:
    """The main text of a page. Where there is none, it may stand in a form around the page, if that has paragraphs to read."""
    html = html or ""
    texts = main_blocks(blocks(html))
    if not texts and re.search(r"<form\b", html, re.I):
        page = blocks(html, True)
        if any(b.plain >= 80 and len(PUNCTUATION.findall(b.text)) > 1 for b in page):
            texts = main_blocks(page)
    return "\n".join(texts)


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (its code points) instead.

    Null and empty html and pages without content give an empty text. Unclosed and crossing tags, pages that end within
    one, and text outside any element are read as far as they go. Other columns are kept; text and n_chars replace columns
    of those names. Each row is read by itself, so repeated rows give the same text.
    """
    importable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [extract(h) for h in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*batch.schema.names[1:], "__text", "__n"])

    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    chosen = pages.select(F.col(html_col).cast("string").alias("__html"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]), "__text string", "__n long"])
    return chosen.mapInArrow(run, schema).toDF(*keep, "text", "n_chars")
