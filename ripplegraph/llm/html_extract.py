"""Main text of web pages by a minimum cut.

A page falls into blocks of text. A classifier gives each block a score by its text, length, links and tag alone, for
content if positive and for boilerplate if negative; it becomes the capacity of an edge to one of two terminals. Elements
whose tag, class, id or role tells what they hold are nodes too, with scores of their own that grow with their blocks.
Edges join each block to the element that tells of it, blocks that follow each other, with capacities that fall with
their distance in the document's tree, and blocks that stand under the same element. The minimum cut between the
terminals gives the labels that fit scores and neighbours best: it takes prose out of sidebars and comments, and keeps
links in articles, lists and tables between paragraphs, and linked sentences among others.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import slices

#: Elements of HTML by what they do to text.
UNSHOWN = set("script style noscript template svg iframe object canvas select textarea button title audio video map datalist".split())
BLOCKS = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Where an end that HTML lets authors leave out is not looked for any further.
SCOPE = set("html body article aside section div main table ul ol dl nav header footer form blockquote figure details".split())
BOILERPLATE_TAGS = set("nav footer aside form menu dialog fieldset".split())
CONTENT_TAGS = {"article", "main"}
BOILERPLATE_WORDS = set(
    "ad ads adv alert banner bio complementary consent contentinfo copyright disqus gdpr header legal login masthead menu modal nav notice notices notification overlay pager popup publicidad publicite reklame related replies reply respond search share sharing signup social subscribe tags teaser toolbar topbar werbung".split()
)
BOILERPLATE_STEMS = tuple("advert adsense breadcrumb comment cookie discussion footer navbar navig newsletter paginat promo recommend sidebar sponsor widget".split())
CONTENT_WORDS = set("article content entry main post story body text prose".split())

#: Capacities in thousandths of log-odds: what an element tells, a block; the edge from a block to it; edges between
#: blocks that follow each other, by distance, and under the same element; what divides them between other elements.
CONTENT_TOLD, BOILERPLATE_TOLD = 5000, 6500
CONTENT_HOLDS, BOILERPLATE_HOLDS = 4500, 6000
FOLLOWING, SIBLING, ACROSS = 2400, 500, 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[/!?a-zA-Z][^>]*\Z", re.S)
_HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_TOLD_OF = re.compile(r"\b(?:has|with|no|without)[-_]\w+")


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    words: frozenset = frozenset()
    chars: int = 0
    link_chars: int = 0


@dataclass
class Block:
    text: str
    element: Element
    link_chars: int


def _hint_words(attributes: str) -> frozenset:
    """Words of an element's class, id and role; not those of what it only says to have or to lack."""
    return frozenset(w for m in _HINTS.finditer(attributes) for w in _WORDS.findall(_TOLD_OF.sub(" ", (m[1] or m[2] or m[3] or "").lower())))


def is_boilerplate(words: frozenset, in_content: bool) -> bool:
    """Whether a word tells of boilerplate; a header inside content is the content's own."""
    told = {w for w in words if w in BOILERPLATE_WORDS or w.startswith(BOILERPLATE_STEMS)}
    return bool(told - {"header"} or told and not in_content and not words & CONTENT_WORDS)


def blocks_of(page: str) -> list[Block]:
    """Blocks of shown text in page order, character references decoded and white space turned into single spaces."""
    root = Element("", None, 0)
    here, out, parts, links, in_link = root, [], [], 0, 0
    at, end = 0, len(page)

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links += len(text.strip())

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(text, here, min(links, len(text))))
                e = here
                while e is not None:
                    e.chars += len(text)
                    e.link_chars += min(links, len(text))
                    e = e.parent
        links = 0

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in UNSHOWN:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag in VOID:
                continue
            if closing:
                e = here
                while e is not None and e.tag != tag:
                    e = e.parent
                here = e.parent if e is not None else here
            else:
                e = here
                while e is not None and e.tag and e.tag not in SCOPE:
                    if e.tag in CLOSES_ITSELF.get(tag, ()) or e.tag == "p":
                        here = e.parent
                        break
                    e = e.parent
                here = Element(tag, here, here.depth + 1, _hint_words(attributes) if attributes else frozenset())
    flush()
    return out


@dataclass(frozen=True)
class Standing:
    """Whether some element from one up tells of content, whether one tells of boilerplate, and the one that decided."""

    good: bool = False
    bad: bool = False
    told_by: Element | None = None


def tells_of_content(element: Element) -> bool:
    return element.tag in CONTENT_TAGS or bool(element.words & CONTENT_WORDS) and element.tag not in BOILERPLATE_TAGS | {"body", "html", ""}


def frames_of(blocks: list[Block]) -> set[int] | None:
    """The elements around the page's first content element, itself included; None where none tells of content."""
    seen: set[int] = set()
    for b in blocks:
        chain, e = [], b.element
        while e is not None and id(e) not in seen:
            seen.add(id(e))
            chain.append(e)
            e = e.parent
        for e in reversed(chain):
            if tells_of_content(e):
                around = set()
                while e is not None:
                    around.add(id(e))
                    e = e.parent
                return around
    return None


def standing(element: Element, page_chars: int, known: dict[int, Standing], frames: set[int] | None) -> Standing:
    """What the elements from this one up tell. `known` keeps what was found, so that each element is looked at once.

    An element that holds most of a page's prose and the first content element, if there is one, is a frame of the page,
    whatever its names; comments that are longer than the article are none.
    """
    chain, e = [], element
    while e is not None and id(e) not in known:
        chain.append(e)
        e = e.parent
    here = known[id(e)] if e is not None else Standing()
    for e in reversed(chain):
        if e.tag not in ("body", "html", ""):
            most = 10 * e.chars > 7 * page_chars and 2 * e.link_chars < e.chars and (frames is None or id(e) in frames)
            bad = here.bad or e.tag in BOILERPLATE_TAGS and not (most and e.tag == "form") or e.tag == "header" and not here.good
            bad |= bool(e.words) and not most and is_boilerplate(e.words, here.good)
            good = here.good or e.tag in CONTENT_TAGS or bool(e.words & CONTENT_WORDS)
            if bad and not here.bad or good and not here.good and not bad:
                here = Standing(good, bad, e)
            elif good and not here.good:
                here = Standing(good, bad, here.told_by)
        known[id(e)] = here
    return here


def score(block: Block) -> int:
    """The classifier's log-odds for content, in thousandths, by the block alone."""
    text, tag = block.text, block.element.tag
    n, density = len(text), block.link_chars / max(len(block.text), 1)
    value = {"h1": 1000, "p": 1200, "pre": 1000, "blockquote": 1000, "li": 400, "td": 400}.get(tag, 300 if tag[:1] == "h" else 0)
    value += min(2000, 20 * n) - 600 - int(4000 * density) + (500 if text[-1] in ".!?:;…\"”»" else 0)
    if "©" in text or "all rights reserved" in text.lower():
        value -= 3000
    return value


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements of the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def graph_of(blocks: list[Block]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Scores of the blocks and, after them, of the elements that tell of them; (node, node, capacity) of the edges."""
    total, known, frames = sum(len(b.text) for b in blocks), {}, frames_of(blocks)
    stands = [standing(b.element, total, known, frames) for b in blocks]
    scores, edges = [score(b) for b in blocks], []
    node: dict[int, int] = {}
    for k, s in enumerate(stands):
        if s.told_by is None:
            continue
        j = node.get(id(s.told_by))
        if j is None:
            j = node[id(s.told_by)] = len(scores)
            scores.append(0)
        scores[j] += -BOILERPLATE_TOLD if s.bad else CONTENT_TOLD
        edges.append((k, j, BOILERPLATE_HOLDS if s.bad else CONTENT_HOLDS))
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        under = id(b.element.parent or b.element)
        if k:
            capacity = FOLLOWING // (1 + _distance(blocks[k - 1].element, b.element))
            edges.append((k - 1, k, capacity if stands[k - 1].told_by is stands[k].told_by else capacity // ACROSS))
        before = last.get(under, k - 1)
        if before != k - 1 and stands[before].told_by is stands[k].told_by:
            edges.append((before, k, SIBLING))
        last[under] = k
    return scores, edges


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node lies on the content side of a minimum cut.

    A node whose score outweighs all its edges takes the score's side in some minimum cut whatever the others do; its
    edges then count as scores of its neighbours. What this leaves open goes through the maximum flow.
    """
    near: list[dict[int, int]] = [{} for _ in scores]
    for a, b, c in edges:
        if a != b and c:
            near[a][b] = near[b][a] = near[a].get(b, 0) + c
    left, label, room = list(scores), [None] * len(scores), [sum(n.values()) for n in near]
    todo = deque(range(len(scores)))
    while todo:
        k = todo.popleft()
        if label[k] is None and abs(left[k]) >= room[k]:
            label[k] = left[k] > 0
            for j, c in near[k].items():
                left[j] += c if label[k] else -c
                room[j] -= c
                del near[j][k]
                todo.append(j)
            near[k] = {}
    if None in label:
        open_nodes = [k for k, v in enumerate(label) if v is None]
        for k, side in zip(open_nodes, _flow_side(open_nodes, left, near), strict=True):
            label[k] = side
    return [bool(v) for v in label]


def _flow_side(nodes: list[int], scores: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Dinic's maximum flow, without recursion; the content side is what the source still reaches."""
    source, sink = -1, -2
    rest = {k: dict(near[k]) for k in nodes} | {source: {}, sink: {}}
    for k in nodes:
        a, b = (source, k) if scores[k] > 0 else (k, sink)
        rest[a][b] = abs(scores[k])
        rest[b].setdefault(a, 0)
    while True:
        level, todo = {source: 0}, deque([source])
        while todo:
            k = todo.popleft()
            for j, c in rest[k].items():
                if c > 0 and j not in level:
                    level[j] = level[k] + 1
                    todo.append(j)
        if sink not in level:
            return [k in level for k in nodes]
        ways, at, path = {k: list(rest[k]) for k in level}, dict.fromkeys(level, 0), [source]
        while path:
            k = path[-1]
            if k == sink:
                steps = list(zip(path, path[1:]))
                room = min(rest[a][b] for a, b in steps)
                for a, b in steps:
                    rest[a][b] -= room
                    rest[b][a] = rest[b].get(a, 0) + room
                del path[next(n for n, (a, b) in enumerate(steps, 1) if not rest[a][b]) :]
                continue
            while at[k] < len(ways[k]) and not (rest[k][ways[k][at[k]]] > 0 and level.get(ways[k][at[k]]) == level[k] + 1):
                at[k] += 1
            if at[k] < len(ways[k]):
                path.append(ways[k][at[k]])
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1


def main_text(page: str | None) -> str:
    """The content blocks of a whole page, joined by newlines."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    label = minimum_cut(*graph_of(blocks))
    return "\n".join(b.text for b, content in zip(blocks, label, strict=False) if content)  # elements follow the blocks


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty page, or one without content, has the empty text. Pages that end in the middle of a tag or of a
    character reference are read as far as they go. Repeated rows give repeated results; an empty table gives none;
    other columns are ignored. Nothing is shuffled.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    id_type = pages.select(F.col(id_col)).schema[0].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(kernel, f"page_id {id_type}, url string, text string, n_chars bigint")
