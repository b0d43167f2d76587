"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.rows import map_rows

# Elements whose content is never text, those without content, blocks, and sections.
SILENT = frozenset("script style noscript template textarea select option iframe object svg math canvas audio video head title button datalist".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SECTIONS = frozenset("html body main article section div td center blockquote".split())
BOILERPLATE = frozenset("nav footer aside menu header dialog form fieldset".split())
# Words of class, id or role that often name what is not the article: a weight of NAMED on the ratio, as for the tags above.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar side aside widget complementary contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login form search share sharing social related recommended comment comments reply replies discussion disqus respond pagination pager toolbar skip copyright legal".split()
)
# Elements that a start tag of the same family ends, the tags that open and end each family, and where the search for one stops.
FAMILIES = (
    ("p", "p", "table td th caption button object html body"),
    ("li", "li", "ul ol menu"),
    ("dt dd", "dt dd", "dl"),
    ("tr", "tr", "table"),
    ("td th", "td th", "tr table"),
    ("option", "option", "select"),
)
P_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("table td th caption button object html body".split())

# Every alternative runs to its end or the page's, so that each character is looked at once whatever is left open.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(" + "|".join(RAW) + r""")\b(ATTRIBUTES)(?:>|\Z).*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(ATTRIBUTES)(?:>|\Z)""".replace(
        "ATTRIBUTES", r"""(?:[^'">]++|"[^"]*+"|'[^']*+'|["'])*+"""
    ),
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[,.;:!?…。，、！？；：]")

#: Weight of a path's neighbours in page order; threshold of a content path, in mean scores of the page's paths; how much a
#: character of another path counts against a section; share of a path's text from which links make it a list of links.
NEIGHBOUR, THRESHOLD, AGAINST, LINKED = 0.25, 1.0, 0.5, 0.5
#: Weights that break near-ties of the ratios: of paths in elements named like boilerplate, of text that stands in no
#: paragraph, heading, item or cell, and of text outside article and main elements where a page has such. Ratios of
#: prose and of menus or notices lie much further apart.
NAMED, BARE, OUTSIDE = 0.1, 0.1, 0.3


@dataclass
class Node:
    """An open element: its path, what it inherits (named: elements named like boilerplate, itself included), its section, and the depth of the nearest scope and family members."""

    tag: str
    path: int
    named: int
    silent: bool
    link: bool
    article: bool
    section: int
    scope: int
    near: tuple[int, ...]


@dataclass
class Block:
    path: int
    named: int
    article: bool
    section: int
    pieces: list[str] = field(default_factory=list)
    links: int = 0


@dataclass
class Page:
    """Text blocks that are shown, in page order; parent, tag and named of each section (a section comes after its parent); leaf tag of each path."""

    blocks: list[Block]
    sections: list[int]
    tags: list[str]
    named: list[int]
    leaves: list[str]


_OPENS = {t: k for k, (opens, _, _) in enumerate(FAMILIES) for t in opens.split()}
_MEMBERS = [frozenset(m.split()) for _, m, _ in FAMILIES]
_STOPS = [frozenset(x.split()) for _, _, x in FAMILIES]


def _named(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in BOILERPLATE and not (tag == "header" and inside_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    names = " ".join(m[2] for m in _NAMES.finditer(attributes)).lower()
    return not NOISE.isdisjoint(_PARTS.findall(names))


def _hidden(attributes: str) -> bool:
    """Whether the attributes say that the element isn't shown: hidden, aria-hidden=true or display:none."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSEEN.search(value):
            return True
    return False


def blocks_of(page: str) -> Page:
    """The page's text by blocks. Each tag costs the same however deep it stands, and each element is closed once."""
    sections, tags, names, leaves = [-1], [""], [0], [""]
    paths: dict[tuple[int, str, bool], int] = {}
    stack = [Node("", 0, 0, False, False, False, 0, 0, (0,) * len(FAMILIES))]
    depths: dict[str, list[int]] = {}  # of the open elements by tag
    blocks: list[Block] = []
    now: dict[int, Block] = {}  # the open block of text, by how many named elements it is in

    def text(raw: str) -> None:
        top = stack[-1]
        if top.silent or not raw:
            return
        block = now.get(top.named)
        if block is None or block.section != top.section:
            block = now[top.named] = Block(top.path, top.named, top.article, top.section)
            blocks.append(block)
        piece = html.unescape(raw)
        block.pieces.append(piece)
        if top.link:
            block.links += len(piece.strip())

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            depths[gone.tag].pop()
            if gone.tag not in INLINE:
                now.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m[4] is None:
            continue
        tag = m[4].lower()
        if m[3]:
            depth = depths[tag][-1] if depths.get(tag) else 0
            if tag == "br":
                now.clear()
            elif depth and not (tag in INLINE and stack[-1].scope > depth):
                pop_to(depth)
            elif tag not in INLINE:
                now.clear()
            continue
        if tag in P_ENDS and stack[-1].near[0]:
            pop_to(stack[-1].near[0])
        family = _OPENS.get(tag, 0)
        if family and stack[-1].near[family]:
            pop_to(stack[-1].near[family])
        if tag not in INLINE:
            now.clear()
        if tag in VOID or m[5].endswith("/") and tag not in SECTIONS:
            continue
        top, depth = stack[-1], len(stack)
        own = _named(tag, m[5], top.article)
        section, path = top.section, top.path
        if tag in SECTIONS:
            sections.append(section)
            tags.append(tag)
            names.append(top.named + own)
            section = len(sections) - 1
        if own or tag not in INLINE:
            path = paths.setdefault((top.path, tag, own), len(leaves))
            if path == len(leaves):
                leaves.append(tag)
        near = tuple([depth if tag in _MEMBERS[k] else 0 if tag in _STOPS[k] else d for k, d in enumerate(top.near)])
        silent = top.silent or tag in SILENT or _hidden(m[5])
        stack.append(Node(tag, path, top.named + own, silent, top.link or tag == "a", top.article or tag in ("article", "main"), section, depth if tag in SCOPE else top.scope, near))
        depths.setdefault(tag, []).append(depth)
    text(page[at:])
    return Page(blocks, sections, tags, names, leaves)


@dataclass
class Ratio:
    """Sums of one path over its blocks: blocks, characters outside links and their squares, punctuation, all characters."""

    blocks: int = 0
    free: int = 0
    squares: int = 0
    marks: int = 0
    chars: int = 0
    named: bool = False
    article: bool = False

    def add(self, block: Block, text: str) -> None:
        free = max(0, len(text) - block.links)
        self.blocks += 1
        self.free += free
        self.squares += free * free
        self.marks += len(_PUNCTUATION.findall(text)) if block.links < len(text) / 2 else 0
        self.chars += len(text)
        self.named |= block.named > 0
        self.article |= block.article

    def fused(self) -> float:
        """Text ratio (mean and spread of the text a block has) times punctuation ratio; prose has long blocks of differing lengths."""
        mean = self.free / self.blocks
        return (mean + math.sqrt(max(0.0, self.squares / self.blocks - mean * mean))) * (0.2 + math.sqrt(self.marks / self.blocks))


def path_scores(kept: list[tuple[Block, str]], leaves: list[str]) -> tuple[dict[int, float], dict[int, Ratio]]:
    """Score of each path, and its sums: text and punctuation over its blocks, links left out, fused, weighed by the link share and the priors, smoothed over neighbours."""
    ratios: dict[int, Ratio] = {}
    for b, t in kept:
        ratios.setdefault(b.path, Ratio()).add(b, t)
    article = any(r.article for r in ratios.values())
    weight = [r.free / r.chars * (NAMED if r.named else 1) * (BARE if leaves[p] in SECTIONS or not leaves[p] else 1) * (OUTSIDE if article and not r.article else 1) for p, r in ratios.items()]
    fused = [w * r.fused() for w, r in zip(weight, ratios.values(), strict=True)]
    smooth = {}
    for k, path in enumerate(ratios):
        near = [fused[i] for i in (k - 1, k + 1) if 0 <= i < len(fused)]
        smooth[path] = (fused[k] + NEIGHBOUR * weight[k] * sum(near)) / (1 + NEIGHBOUR * len(near))
    return smooth, ratios


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by one line feed; empty if there is none.

    Paths over the threshold are content. The article is the section with the most text of content paths less
    AGAINST times that of other paths, the innermost of equal ones. Inside it all text stays but lists of
    links, and what stands in elements named like boilerplate inside the section, unless its path has the page's
    best score. Where the section is the whole page, text that stands bare in it needs a content path too.
    """
    got = blocks_of(page or "")
    lines = [" ".join("".join(b.pieces).split()) for b in got.blocks]
    kept = [(b, t) for b, t in zip(got.blocks, lines, strict=True) if t]
    if not kept:
        return ""
    score, ratios = path_scores(kept, got.leaves)
    level, top = THRESHOLD * sum(score.values()) / len(score), max(score.values())
    gain = [0.0] * len(got.sections)
    for b, t in kept:
        gain[b.section] += len(t) * (1 if score[b.path] >= level else -AGAINST)
    for s in range(len(gain) - 1, 0, -1):
        gain[got.sections[s]] += gain[s]
    best = max(range(len(gain)), key=lambda s: (gain[s], s)) if max(gain) > 0 else 0
    inside = [False] * len(gain)
    for s in range(len(gain)):
        inside[s] = s == best or s > 0 and inside[got.sections[s]]
    whole = got.tags[best] in ("", "html", "body")

    def stays(b: Block) -> bool:
        if not inside[b.section]:
            return False
        r = ratios[b.path]
        if b.named > got.named[best] or r.free < (1 - LINKED) * r.chars:
            return score[b.path] == top
        return not whole or score[b.path] >= level or not (got.leaves[b.path] in SECTIONS or not got.leaves[b.path])

    return "\n".join([t for b, t in kept if stays(b)])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages.

    The whole html is read; null and empty pages, and pages without an article, have empty text. Paths
    are told apart in each page by itself, so equal pages have equal texts. Elements that are left open
    end where HTML lets them end. Repeated rows repeat; an empty table gives no rows.
    """

    def make():
        def each(rows):
            texts = [main_text(h) for h in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return each

    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return map_rows(pages.select(*cols), make, "page_id long, url string, text string, n_chars long")
