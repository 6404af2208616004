"""Main text of web pages by two passes of block rules.

A page is cut into blocks: the text between block-level tags, with its words, the share of
them that are stop words, and the share of its characters that stand in links. The first
pass decides a block by these and by the containers it stands in; short blocks, and those
whose figures say little, stay open. The second pass gives every open block the label of
its nearest decided neighbours, and a heading that of the block it heads.

Containers: tags, roles and words of class and id mark menus, headers, footers, sidebars,
notices, adverts, forms and reader comments, whose blocks are bad. Where a page marks its
article (``article``, ``main``), all blocks elsewhere are bad, and inside it only links
decide against a block. Where no long block of a page holds stop words in a share that a
known language has, its language isn't one of the lists', and that share isn't asked for.

Defined results: a null page is the empty page; a page without main text gives the empty
text; rows that repeat an id stay separate; unclosed, crossed and cut-off tags are read as
far as they go; character references without a meaning stay as they are. Pages are read
whole, whatever their length, a few at a time.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import sized_batches

#: Characters of a short and of a long block; shares of stop words; shares of linked characters.
SHORT, LONG, STOPS_LOW, STOPS_HIGH, LINKS_MOST, LINKS_MOST_IN_PROSE = 70, 200, 0.2, 0.3, 0.2, 0.5

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been before but by can could did do for from had has have he her his how i if in into is it its
    like me more most my no not now of on one only or other our out over she so some such than that the their them then there these they this to up us was
    we were what when which who will with would you your
    aber alle als am an auch auf aus bei bin bis da das dass dem den der des die doch durch ein eine einem einen einer eines er es für hat hatte haben ich
    ihr im in ist kann man mehr mit nach nicht noch nur ob oder sehr sein sich sie sind so über um und uns unter vom von vor war was wenn werden wie wird wir zu zum zur
    au aux avec ce ces cette comme dans de des deux donc du elle elles en est et été eux il ils je la le les leur lui mais même ne nous on ont ou où par pas
    plus pour qu que qui sa sans se ses si son sont sur tout très tu un une vous y à
    al algo como con contra cuando de del desde donde dos el ella ellos en entre era es esta estas este esto estos fue ha hay hasta la las le les lo los más
    me mi muy ni no nos o para pero por porque que se según ser si sin sobre son su sus también tan tiene todo un una uno y ya
    """.split()
)
#: Tags that end a block, without content, of headings, that end their like, whose content is no text; tags and roles of containers without main text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSE_THEMSELVES = frozenset("li dt dd option tr td th".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object audio video canvas select button noframes xmp".split())
BAD_TAGS = frozenset("nav footer aside menu dialog head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words of class and id of containers without main text; ``OTHERS`` hold also if an article is so marked, and a name with one of ``BESIDES`` says nothing.
OTHERS = frozenset("comment comments disqus replies reply respond discussion related recommended recommendations teaser".split())
BESIDES = frozenset("has with without no".split())
HINTS = OTHERS | frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner banners sidebar side menu menus nav navbar
    navigation breadcrumb breadcrumbs crumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup
    login share sharing sharebar social footer foot header masthead topbar copyright legal disclaimer pagination pager toolbar widget widgets search skip
    tagcloud trackbacks
    """.split()
)

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: What holds inside a container: it is no main text, perhaps none (an article within still is), the article, an article's header.
_BAD, _WEAK, _ARTICLE, _HEADER = 1, 2, 4, 8


class Block(NamedTuple):
    text: str
    tag: str
    inside: int
    links: float
    stops: float


def _holds(tag: str, attributes: str, inside: int) -> int:
    """The containers' marks within an element of ``tag`` that stands in ``inside``."""
    if tag in ("article", "main"):
        inside = inside & ~_WEAK | _ARTICLE
    if tag in BAD_TAGS:
        inside |= _BAD
    elif tag == "header":
        inside |= _HEADER if inside & _ARTICLE else _BAD
    elif tag == "form":
        inside |= _WEAK
    if "=" in attributes or "hidden" in attributes:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        role = found.get("role", "").lower()
        if "hidden" in found or found.get("aria-hidden") == "true" or role in BAD_ROLES or _HIDDEN.search(found.get("style", "").lower()):
            inside |= _BAD
        if role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
            inside = inside & ~_WEAK | _ARTICLE
        named = (set(_NAME.findall(x)) for x in f"{found.get('class', '')} {found.get('id', '')}".lower().split())
        names = set().union(*(x for x in named if x.isdisjoint(BESIDES)))
        if names & OTHERS:
            inside |= _BAD
        elif tag not in ("article", "main", "body", "html") and not names.isdisjoint(HINTS):
            inside |= _WEAK
    return inside


def read_blocks(page: str) -> list[Block]:
    """The page's blocks in order, those without text left out."""
    out: list[Block] = []
    stack: list[list] = [["", 0, 0]]  # open elements: tag, marks, inline elements of the same tag inside
    opened: dict[str, int] = {}
    parts, linked, link, breaks, at = [], 0, False, 0, 0

    def end_block():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            words = _WORD.findall(text.lower())
            tag = next((e[0] for e in reversed(stack) if e[0] in BLOCK), "")
            out.append(Block(text, tag, stack[-1][1], min(1.0, linked / len(text)), sum(w in STOP_WORDS for w in words) / max(1, len(words))))
        linked = 0

    def close(tag: str):
        while True:
            top = stack.pop()
            opened[top[0]] -= 1
            if top[0] == tag:
                return

    while at < len(page):
        found = _MARKUP.search(page, at)
        piece = page[at : found.start()] if found else page[at:]
        if piece:
            parts.append(piece)
            if not piece.isspace():
                breaks = 0
                linked += len(" ".join(html.unescape(piece).split())) if link else 0
        if not found:
            break
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        closing, tag, attributes = found[1] or found[4], tag.lower(), found[3] or found[6] or ""
        if tag in RAW and not closing:
            parts.append(" ")
            if not attributes.endswith("/"):
                stop = _RAW_END[tag].search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                end_block()
        elif tag in BLOCK:
            end_block()
            link, breaks = False, 0
            if closing:
                if opened.get(tag):
                    close(tag)
            elif tag not in VOID:
                around = next(e[0] for e in reversed(stack) if e[0] in BLOCK or not e[0])
                if around == "p" or around == tag and tag in CLOSE_THEMSELVES:
                    close(around)
                stack.append([tag, _holds(tag, attributes, stack[-1][1]), 0])
                opened[tag] = opened.get(tag, 0) + 1
        elif tag == "a":
            link = not closing and "href" in attributes.lower()
        if tag not in BLOCK and tag not in VOID:
            top = stack[-1]
            if closing:
                if top[0] == tag:
                    if top[2]:
                        top[2] -= 1
                    else:
                        end_block()
                        close(tag)
            elif top[0] == tag:
                top[2] += 1
            elif attributes and (marks := _holds(tag, attributes, top[1])) != top[1]:
                end_block()
                stack.append([tag, marks, 0])
                opened[tag] = opened.get(tag, 0) + 1
    end_block()
    return out


def _outside(b: Block) -> bool:
    """Whether a block stands in a container without main text."""
    return bool(b.inside & (_BAD | _WEAK) or b.inside & _HEADER and b.tag not in HEADINGS)


def first_pass(blocks: list[Block]) -> list[bool | None]:
    """True for main text, False for none, None where the block alone doesn't decide it."""
    fine = [not _outside(b) for b in blocks]
    marked = any(ok and b.inside & _ARTICLE for ok, b in zip(fine, blocks, strict=True))
    known = any(ok and len(b.text) >= LONG and b.stops >= STOPS_LOW for ok, b in zip(fine, blocks, strict=True))
    labels = []
    for ok, b in zip(fine, blocks, strict=True):
        prose = len(b.text) >= LONG and b.stops >= STOPS_HIGH
        if not ok or marked and not b.inside & _ARTICLE or b.links > (LINKS_MOST_IN_PROSE if prose else LINKS_MOST):
            labels.append(False)
        elif len(b.text) < SHORT:
            labels.append(None if marked or not b.links else False)
        elif known and b.stops < STOPS_LOW:
            labels.append(None if marked else False)
        else:
            labels.append(True if len(b.text) >= LONG and (not known or b.stops >= STOPS_HIGH) else None)
    return labels


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Every open label from the nearest decided neighbours, a heading's from the block it heads.

    An article's ends count as main text, a page's as none. In an article adverts and other
    containers don't count as neighbours, and a block goes only if both neighbours go.
    """
    region = [bool(b.inside & _ARTICLE) for b in blocks]
    counts = [not (inside and _outside(b)) for inside, b in zip(region, blocks, strict=True)]

    def nearest(places) -> list[tuple[int, bool]]:
        side, far, label, last = [(0, False)] * len(blocks), 0, None, None
        for i in places:
            if region[i] != last:
                far, label, last = 0, region[i], region[i]
            far += 1
            side[i] = (far, label)
            if labels[i] is not None and counts[i]:
                far, label = 0, labels[i]
        return side

    out = list(labels)
    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    for i, b in enumerate(blocks):
        if out[i] is None and b.tag not in HEADINGS:
            (d0, was), (d1, comes) = before[i], after[i]
            out[i] = was or comes if region[i] else was if was == comes or d0 < d1 else comes if d1 < d0 else len(b.text) >= SHORT
    headed, last = False, None
    for i in range(len(blocks) - 1, -1, -1):
        if region[i] != last:
            headed, last = region[i], region[i]
        if out[i] is None:
            out[i] = headed
        if counts[i]:
            headed = out[i]
    return out


def main_text(page: str | None) -> str:
    """Blocks of main text, joined by an empty line."""
    blocks = read_blocks(page or "")
    return "\n\n".join(b.text for b, ok in zip(blocks, second_pass(blocks, first_pass(blocks)), strict=True) if ok)


def label_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, place, tag, text, links, stops, decided, kept) of every block: what each pass makes of it."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in sized_batches(batch):
                rows = []
                for key, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    blocks = read_blocks(page or "")
                    first = first_pass(blocks)
                    rows += [(key, i, b.tag, b.text, b.links, b.stops, d, k) for i, (b, d, k) in enumerate(zip(blocks, first, second_pass(blocks, first), strict=True))]
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()), strict=True))], [id_col, "place", "tag", "text", "links", "stops", "decided", "kept"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, place int, tag string, text string, links double, stops double, decided boolean, kept boolean")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every whole page."""
    keys = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))

    def run(batches):
        for batch in batches:
            for part in sized_batches(batch, 2):
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, F.col(html_col)).mapInArrow(run, f"{keys}, text string, n_chars long")
