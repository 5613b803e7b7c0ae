"""Main text of web pages by two passes over their blocks.

Markup is cut into blocks at block-level tags. Pass one labels each block from where it stands
(navigation, footers, adverts, forms and the like are boilerplate), from its share of link text, its
length and its stop-word density. Short or undecided blocks stay open; pass two gives them the label of
the nearest decided neighbours in the same region, a heading that of the block below it.

Where a page declares its article (``article``, ``main``), only blocks in it can be text, and open blocks
there default to text: what the page calls its article is dropped only as boilerplate or as lists of links.

Null or empty html gives an empty text. Broken markup is read as far as it goes: an unclosed script
or comment runs to the end of the page, a stray end tag is ignored, a lone ``<`` is text. Pages are
rows of their own, so repeated rows are extracted again, and other columns do not matter.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm.batches import map_rows

# Function words of the languages covered; density needs only the most frequent ones.
STOP_WORDS = frozenset(
    (
        "a an and are as at be but by for from had has have he her his in is it not of on or she that the they this to"
        " was were which will with you"
        " au aux avec ce dans de des du elle en est et il je la le les mais ne nous on ou par pas pour que qui sur un"
        " une vous"
        " aber als am auch auf aus bei das dem den der des die ein eine einen er es für ich im ist mit nach nicht oder"
        " sich sie sind und von war wie wir zu zum zur"
        " al como con del el ella es este ha hay las lo los más muy no o para pero por se sin su también una y"
    ).split()
)

LINK_DENSITY_MAX = 0.5
LENGTH_SHORT = 70
LENGTH_LONG = 200
STOP_DENSITY_LOW = 0.2
STOP_DENSITY_HIGH = 0.3

_RAW = "script|style|noscript|template|textarea|iframe|title|svg|canvas|select|option|datalist|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL | re.IGNORECASE,
)
_OPEN_TAG = re.compile(r"<(?![!?])")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_NAMING = frozenset("class id role itemprop".split())
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")

_BLOCK_TAGS = frozenset(
    (
        "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
        " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p"
        " pre search section summary table tbody td tfoot th thead tr ul"
    ).split()
)
_VOID_TAGS = frozenset("hr".split())
_EMPTY_TAGS = frozenset("area base br col embed img input link meta param source track wbr".split())
# Without attributes these change nothing for what stands in them.
_PLAIN_TAGS = frozenset("p li dd dt td th tr tbody thead tfoot h1 h2 h3 h4 h5 h6 div section table ul ol".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What an opening tag closes without a closing tag, looked for up to the nearest of the elements that hold such tags.
_LIST, _CELLS = frozenset("ul ol menu dir".split()), frozenset("td th".split())
_CLOSES = {
    "li": (frozenset(["li"]), _LIST),
    "dd": (frozenset("dd dt".split()), frozenset(["dl"])),
    "dt": (frozenset("dd dt".split()), frozenset(["dl"])),
    "td": (_CELLS, frozenset("tr table".split())),
    "th": (_CELLS, frozenset("tr table".split())),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    **{t: (frozenset("tbody thead tfoot".split()), frozenset(["table"])) for t in ("tbody", "thead", "tfoot")},
}
_BOILER_TAGS = frozenset("nav footer aside form menu dialog button search head fieldset".split())
_MAIN_TAGS = frozenset("article main".split())
# Parts of class, id and role names.
_BOILER_NAMES = frozenset(
    (
        "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary"
        " consent contentinfo cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu modal"
        " nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion related"
        " replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets"
    ).split()
)
# Of these, names of what others wrote or what leads elsewhere: an article in it is not the page's.
_OTHER_NAMES = frozenset("comment comments discussion disqus related replies reply".split())
# What follows in a name tells what a layout has or lacks, not what it is: has-sidebar, no-sidebar, with-menu.
_LAYOUT_WORDS = frozenset("has no with without".split())
# Names that mean boilerplate only as the last part of a name, or before parts that tell its place or shape.
_AMBIGUOUS_NAMES = frozenset(
    (
        "banner complementary copyright disclaimer discussion menu navigation notice notification promotion related replies"
        " reply search share sharing social sponsor subscribe"
    ).split()
)
_SHAPES = frozenset(
    (
        "area bar block body bottom box btn button buttons col column container content footer form group header heading"
        " icon icons inner item items left link links list main mobile nav outer panel posts primary right row secondary"
        " section site slot text title top unit widget wrap wrapper"
    ).split()
)
_MAIN_NAMES = frozenset("article articlebody content main post entry story body page wrapper".split())

GOOD, BAD, NEAR, OPEN = "good", "bad", "near", "open"
#: Not boilerplate; boilerplate by names alone; by names of others' texts; by tag or because it is hidden.
CLEAR, NAMED, OTHERS, FIXED = range(4)


@dataclass(slots=True)
class Block:
    text: str
    link_share: float
    region: int
    boiler: bool
    main: bool
    heading: bool
    list_item: bool
    label: str = OPEN
    rescued: bool = False


def _attributes(attributes: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for match in _ATTRIBUTE.finditer(attributes):
        found.setdefault(match[1].lower(), match[2] or match[3] or match[4] or "")
    return found


def _names(attributes: dict[str, str]) -> set[str]:
    found: set[str] = set()
    for attribute in _NAMING & attributes.keys():
        for name in attributes[attribute].lower().split():
            parts = _NAME.findall(name)
            for place, part in enumerate(parts):
                if part in _LAYOUT_WORDS:
                    break
                if part not in _AMBIGUOUS_NAMES or _SHAPES.issuperset(parts[place + 1 :]):
                    found.add(part)
    return found


def _is_hidden(attributes: dict[str, str]) -> bool:
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or bool(_INVISIBLE.search(attributes.get("style", "")))
    )


def _enter(tag: str, text: str, boiler: int, main: bool, rescued: bool) -> tuple[int, bool, bool]:
    """How far what stands in this element is boilerplate, whether it is in the article, and whether in an article
    that undid a label from names."""
    if boiler == FIXED or tag in _BOILER_TAGS or (tag == "header" and not main):
        return FIXED, main, rescued
    attributes = _attributes(text) if text else {}
    names = _names(attributes)
    if tag not in ("body", "html"):
        if _is_hidden(attributes):
            return FIXED, main, rescued
        if names & _BOILER_NAMES and not (names & _MAIN_NAMES and not names & {"comment", "comments"}):
            return max(boiler, OTHERS if names & _OTHER_NAMES else NAMED), main, rescued
    article = tag in _MAIN_TAGS or "articlebody" in names
    if boiler and article and not main and (tag == "main" or boiler == NAMED):
        return CLEAR, True, tag != "main"
    return boiler, main or (article and not boiler), rescued


def _closed(page: str) -> str:
    """The page with what follows its last ``>`` made text, as no tag can end there; scanning is linear then."""
    last = page.rfind(">") + 1
    return page[:last] + _OPEN_TAG.sub("&lt;", page[last:])


def _implied(stack: list[tuple], tag: str) -> None:
    """Drop the open elements that an opening block tag closes."""
    if stack[-1][0] == "p" or (tag in _HEADINGS and stack[-1][0] in _HEADINGS):
        stack.pop()
    kinds, holders = _CLOSES.get(tag, ((), ()))
    if kinds:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in holders:
                break
            if stack[depth][0] in kinds:
                del stack[depth:]
                break


def blocks_of(page: str) -> list[Block]:
    """The non-empty blocks of a page, in order, not yet labelled."""
    found: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    # Open elements: tag, region, boilerplate, in the article, in a rescued one.
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, CLEAR, False, False)]
    regions = links = at = 0
    inner = ""
    # An inline element that does not show, and how many of its name are open.
    unseen, depth_unseen = "", 0
    page = _closed(page)

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(html_lib.unescape("".join(link_parts)).split())) if link_parts else 0
                _, region, boiler, main, rescued = stack[-1]
                found.append(
                    Block(
                        text, linked / len(text), region, boiler != CLEAR, main, inner in _HEADINGS, inner == "li",
                        rescued=rescued,
                    )
                )
            parts.clear()
            link_parts.clear()

    def add(text: str) -> None:
        if unseen:
            return
        parts.append(text)
        if links:
            link_parts.append(text)

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        name = token[3] or token[6]
        if not name:
            continue
        tag, closing = name.lower(), bool(token[2] or token[5])
        attributes = token[4] or token[7] or ""
        if tag not in _BLOCK_TAGS:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                add(" ")
            if unseen:
                if tag == unseen and tag not in _EMPTY_TAGS:
                    depth_unseen += -1 if closing else 1
                    unseen = unseen if depth_unseen else ""
            elif attributes and not closing and tag not in _EMPTY_TAGS and _is_hidden(_attributes(attributes)):
                unseen, depth_unseen = tag, 1
            continue
        flush()
        links, unseen = 0, ""
        inner = "" if closing else tag
        if tag in _VOID_TAGS:
            continue
        if closing:
            # What a cell or an item holds is closed with it; nothing outside its list or table is.
            _, holders = _CLOSES.get(tag, ((), ()))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
                if stack[depth][0] in holders:
                    break
        else:
            _implied(stack, tag)
            _, region, *before = stack[-1]
            after = _enter(tag, attributes, *before) if attributes or tag not in _PLAIN_TAGS else before
            if (after[0] != CLEAR, *after[1:]) != (before[0] != CLEAR, *before[1:]):
                regions += 1
                region = regions
            stack.append((tag, region, *after))
    if at < len(page):
        add(page[at:])
    flush()
    return found


# Characters that do the work of function words where words are not set apart.
_STOP_CHARACTERS = re.compile("[\u7684\u4e86\u662f\u5728\u4e0d\u6709\u548c\u4e5f\u5c31\u8fd9\u3092\u306b\u306f\u304c\u3067\u3068\u3082\u306e\u305f\u3066]")
_IDEOGRAPHS = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]")
# Characters of such scripts that make as much as a word of others.
_CHARACTERS_A_WORD = 4


def _stop_density(text: str) -> float:
    dense = len(_IDEOGRAPHS.findall(text)) if not text.isascii() else 0
    if dense * 2 > len(text):
        return min(1.0, _CHARACTERS_A_WORD * len(_STOP_CHARACTERS.findall(text)) / dense)
    tokens = text.lower().split()
    return sum(t.strip(".,;:!?\"'()") in STOP_WORDS for t in tokens) / len(tokens)


def _first_pass(block: Block, declared: bool) -> str:
    if block.boiler or (declared and not block.main):
        return BAD
    if block.link_share > LINK_DENSITY_MAX:
        return OPEN if declared and not block.list_item else BAD
    if block.heading:
        return OPEN
    length = len(block.text)
    if length < LENGTH_SHORT:
        return BAD if block.link_share > 0 and not declared else OPEN
    density = _stop_density(block.text)
    if density >= STOP_DENSITY_HIGH:
        return GOOD if length > LENGTH_LONG or declared else NEAR
    if density >= STOP_DENSITY_LOW:
        return NEAR
    return OPEN if declared else BAD


def label_blocks(found: list[Block]) -> list[Block]:
    """Both passes; every block ends as ``good`` or ``bad``."""
    # Articles in what is named a sidebar or the like are teasers if the page has one elsewhere.
    if any(block.main and not block.boiler and not block.rescued for block in found):
        for block in found:
            block.boiler |= block.rescued
    declared = any(block.main and not block.boiler for block in found)
    for block in found:
        block.label = _first_pass(block, declared)
    count = len(found)
    before: list[int] = [-1] * count
    after: list[int] = [-1] * count
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        before[i] = last.get(block.region, -1)
        if block.label in (GOOD, BAD):
            last[block.region] = i
    last.clear()
    for i in range(count - 1, -1, -1):
        after[i] = last.get(found[i].region, -1)
        if found[i].label in (GOOD, BAD):
            last[found[i].region] = i
    final = []
    for i, block in enumerate(found):
        label = block.label
        if label in (NEAR, OPEN):
            default = GOOD if declared or label == NEAR else BAD
            above = found[before[i]].label if before[i] >= 0 else None
            below = found[after[i]].label if after[i] >= 0 else None
            if block.heading and below:
                label = below if not declared else GOOD if GOOD in (above, below) else below
            elif above and below and above != below:
                label = default
            elif declared and not block.list_item and not block.link_share and not (above and below):
                # A list of links beside it says nothing about a paragraph of an article.
                label = default
            else:
                label = above or below or default
        final.append(label)
    for block, label in zip(found, final):
        block.label = label
    return found


def main_text(page: str | None) -> str:
    """Blocks labelled good, joined by line feeds."""
    return "\n".join(b.text for b in label_blocks(blocks_of(page)) if b.label == GOOD) if page else ""


def _row(page_id, url, page) -> Iterator[tuple]:
    found = label_blocks(blocks_of(page)) if page else []
    kept = [b.text for b in found if b.label == GOOD]
    text = "\n".join(kept)
    yield page_id, url, text, len(text), len(found), len(kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text``, ``n_chars``, ``n_blocks`` found and ``n_kept``."""
    kind = dict(pages.dtypes)
    return map_rows(
        pages.select(F.col(id_col), F.col(url_col), F.col(html_col)),
        lambda: _row,
        f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars long, n_blocks int, n_kept int",
    )
