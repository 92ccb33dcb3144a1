"""Main text of web pages by tree scoring.

A page becomes a tree of blocks. Every paragraph passes points for its length and its commas to
its ancestors, less with every level; a container's points are discounted by the share of its text
that stands in links. The best container and those siblings that score well or read like paragraphs
are kept, and their blocks are joined in page order. Parts that by element, role, class or id
are menus, headers, footers, sidebars, notices, adverts, forms, comments or hidden are no part of
the tree.

One page is one row, so nothing is shuffled; work is in proportion to its length, however deep or broken it is. A tag that never
ends is text, and where quotes don't pair up tags end at the next ``>``. A null html is empty; a page without text gives the empty
string; text without markup is one block; elements left open close where their parent does.
Elements left open inside an unwanted part end with the part, and an unwanted part left open ends where a block around it
does. Repeated rows and null ids come out as often as they went in; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.common import table

# Elements and names by their part in a page.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = set("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption caption address summary legend".split())
DROPPED = set("nav footer aside form head script style noscript template button select textarea iframe object svg canvas menu dialog audio video option math".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist respond reply replies disqus discussion share sharing social related recommended widget pager pagination search form hidden".split()
)
HEADS = {"header"}
#: Words that may stand beside them in one name, which is then the name of a part all the same.
PLACES = set("site page global top bottom left right main primary secondary outer inner wrap wrapper container box block area bar list item section".split())
#: Names that also stand for content: they need links or form controls as a second sign.
UNSURE = set("notice alert banner promotion promo cookie cookies consent popup rail menu navigation toolbar search form share sharing social related recommended widget discussion subscription login respond".split())
CONTROLS = {"form", "button", "select", "textarea", "input"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
BONUS = {"article": 25, "main": 25, "section": 3, "div": 2, "pre": 2, "td": 1, "blockquote": 1}

# Elements whose content is no markup.
RAW = set("script style noscript template textarea title svg iframe".split())
_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("bad", "block", "controls", "depth", "inside", "links", "menu", "parent", "points", "size", "suspect", "tag", "top")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.points, self.size, self.links = float(BONUS.get(tag, 0)), 0, 0
        self.depth = parent.depth + 1 if parent else 0
        self.block: Node = self if tag in BLOCKS or parent is None else parent.block
        self.suspect = self.controls = self.bad = self.inside = self.menu = False
        self.top: Node | None = None


def tokens_of(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """Text (tag empty) and tags (name, whether it ends the element, attributes) of a page, in one pass."""
    at, n, paired, ends = 0, len(page), True, {}
    last = page.rfind(">")

    def tag_end(i: int) -> int:
        """Where the tag that is open at ``i`` ends; -1: nowhere."""
        nonlocal paired
        j = i
        while paired:
            m = _STOP.search(page, j)
            if m is None or m[0] == ">":
                break
            j = page.find(m[0], m.end()) + 1
            if not j:
                paired = False
        else:
            return page.find(">", i)
        if m is None:
            paired = False
            return page.find(">", i)
        return m.start()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], False, "", ""
            return
        if lt > at:
            yield page[at:lt], False, "", ""
        at = lt + 1
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _OPEN.match(page, lt) if lt < last else None  # a name that reaches to the end is read once
        if lt >= last or not (m or page.startswith(("<!", "<?"), lt)):
            yield "<", False, "", ""
            continue
        if m is None:
            at = page.find(">", lt) + 1
            continue
        stop = tag_end(m.end())
        if stop < 0:
            yield "<", False, "", ""
            continue
        at, tag = stop + 1, m[2].lower()
        if tag in RAW and not m[1]:
            if ends.get(tag) != -1:
                close = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                ends[tag] = -1 if close is None else close.end()
            at = n if ends[tag] == -1 else ends[tag]
            continue
        yield "", m[1] == "/", tag, page[m.end() : stop]


def _unwanted(tag: str, attrs: str, inside: bool) -> bool | None:
    """Whether an element is not part of an article; ``inside``: it stands in one already, where a heading is its own.

    A name counts as a whole: ``site-footer`` is a footer, ``has-sidebar`` is none. One of which only a word is known, or that has another sense, leaves it open (None)."""
    unsure = False
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attrs:
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            parts, around = (NAMES, frozenset()) if inside else (NAMES | HEADS, PLACES)
            for own in (set(_WORD.findall(x)) for x in value.split()):
                if own & parts - UNSURE and own <= parts | around:
                    return True
                unsure |= bool(own & NAMES)
    return (True if tag == "a" else None) if unsure else False


def blocks_of(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements in order, and the blocks of a page: element, text, characters of it in links."""
    root = Node("html", None)
    path, nodes, out = [root], [root], []
    opened: Counter[str] = Counter()  # of ``path`` without the root
    text: list[str] = []
    linked = 0
    skip: list[str] = []  # open elements of an unwanted part
    skipped: Counter[str] = Counter()
    pending: list[Node] = []  # open elements of unsure names without controls so far

    def end_block() -> None:
        nonlocal linked
        if text:
            said = " ".join(entities.unescape("".join(text)).split())
            if said:
                out.append((path[-1].block, said, min(linked, len(said))))
            text.clear()
        linked = 0

    def leave() -> Node:
        gone = path.pop()
        opened[gone.tag] -= 1
        if pending and pending[-1] is gone:
            pending.pop()
        return gone

    for said, closing, tag, attrs in tokens_of(page):
        if not tag:
            if not skip:
                text.append(said)
                if opened["a"]:
                    linked += len(said)
            continue
        if skip:
            if tag in VOID:
                continue
            if not closing:
                if not attrs.endswith("/"):
                    skip.append(tag)
                    skipped[tag] += 1
                continue
            if skipped[tag]:
                while True:
                    gone = skip.pop()
                    skipped[gone] -= 1
                    if gone == tag:
                        break
                continue
            if tag not in BLOCKS or not opened[tag]:
                continue
            skip.clear()  # a block around the unwanted part ends
            skipped.clear()
        if not closing:
            if tag == "br":
                text.append(" ")
                continue
            if tag in CONTROLS:
                for n in pending:
                    n.controls = True
                pending.clear()
            if tag in VOID:
                if tag == "hr":
                    end_block()
                continue
            unwanted = _unwanted(tag, attrs, opened["article"] + opened["main"] > 0)
            if unwanted:
                if tag in BLOCKS or tag in DROPPED:
                    end_block()
                if not attrs.endswith("/"):
                    skip.append(tag)
                    skipped[tag] += 1
                continue
            if tag in BLOCKS:
                end_block()
                shut = {"p"} | CLOSES.get(tag, set())
                while len(path) > 1 and path[-1].block.tag in shut:
                    block = path[-1].block
                    while leave() is not block:
                        pass
            path.append(Node(tag, path[-1]))
            opened[tag] += 1
            nodes.append(path[-1])
            if unwanted is None:
                path[-1].suspect = True
                pending.append(path[-1])
        elif opened[tag]:
            if tag in BLOCKS:
                end_block()
            while leave().tag != tag:
                pass
        elif tag in BLOCKS:
            end_block()
    end_block()
    return nodes, out


def _density(n: Node) -> float:
    return n.links / n.size if n.size else 0.0


def _measured(nodes: list[Node], found: list[tuple[Node, str, int]]) -> None:
    """Gives every element the characters, and those in links, of all inside it. A parent stands before its children."""
    for n in nodes:
        n.size = n.links = 0
    for block, said, links in found:
        block.size += len(said)
        block.links += links
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.links += n.links


def main_text(page: str | None) -> str:
    nodes, found = blocks_of(page or "")
    _measured(nodes, found)
    whole = nodes[0].size
    for n in nodes:  # what stands in an element of an unsure name that is mostly links, or holds controls and not most of the page
        n.bad = (n.parent is not None and n.parent.bad) or (n.suspect and (2 * n.links > n.size or (n.controls and 2 * n.size < whole)))
    found = [b for b in found if not b[0].bad]
    if not found:
        return ""
    _measured(nodes, found)
    scored: dict[Node, None] = {}
    for block, said, links in found:
        points = (1 + said.count(",") + min(len(said) / 100, 10.0)) * (1 - links / len(said))
        n: Node | None = block.parent.block if block.tag in PARAGRAPHS and block.parent else block
        for share in (1, 2, 6, 9):
            if n is not None:
                n.points += points / share
                scored[n] = None
                n = n.parent.block if n.parent else None
        while n is not None and n not in scored:  # further ancestors get nothing, and are containers all the same
            scored[n] = None
            n = n.parent.block if n.parent else None
    value = {n: n.points * (1 - _density(n)) for n in scored}
    best = max(scored, key=lambda n: (value[n], n.depth))
    least = max(10.0, 0.2 * value[best])
    around: Node | None = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is not None and _density(around) < 0.5:
        best = around  # a whole article, however its parts score
    keep = {best}
    if best.parent is not None:
        for n in nodes:
            n.top = n if n.parent is best.parent else n.parent.top if n.parent is not None else None
        for n in {block.top for block, _, _ in found}:
            if n is not None and n is not best and n.tag not in ("li", "td", "th", "tr"):
                # beside the best part of no article all blocks are its own, beside an article only what reads like its text or title
                own = n.tag in PARAGRAPHS and _density(n) < 0.25 and (best.tag not in ("article", "main") or n.size > 80 or n.tag in ("h1", "h2"))
                if value.get(n, 0.0) >= least or own:
                    keep.add(n)
    for n in nodes:
        n.inside = n in keep or (n.parent is not None and n.parent.inside)
        lists = n.tag in ("ul", "ol", "table", "div", "section") and _density(n) > 0.8
        n.menu = n not in keep and (lists or (n.parent is not None and n.parent.menu))
    return "\n".join(said for block, said, _ in found if block.inside and not block.menu)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array([len(x) for x in said], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
