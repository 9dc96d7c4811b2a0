"""Main text of web pages by two-pass block rules: decide blocks by themselves, then the rest by their neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import in_arrow

#: Frequent function words; a text in one of these languages holds many of them.
STOP_WORDS = {
    "de": "aber als am an auch auf aus bei bis da das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann man mit nach nicht noch nur oder schon sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur",
    "en": "a all also an and are as at be been but by can do for from had has have he her his i if in into is it its more my no not of on one or our out she so that the their them then there these they this to up was we were what when which who will with would you your",
    "es": "a al algo como con cuando de del desde donde e el ella en entre era es esta este esto fue ha hay la las le les lo los mas me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene todo un una uno y ya",
    "fr": "à au aux avec c ce ces cette comme d dans de des du elle en est et être eu il ils je l la le les leur lui mais me même n ne nous on ont ou par pas plus pour qu que qui s sa se ses si son sont sur te tu un une vous y",
}
#: A block with at least this share of stop words, over enough words, is running text.
DENSE, ENOUGH_WORDS = 0.2, 8
#: Share of a block's characters inside links: above LINKED it is navigation, up to FEW_LINKS it may be text.
LINKED, FEW_LINKS = 0.5, 0.33

#: Elements whose content is never text.
RAW = "script style noscript template svg math canvas iframe object audio video map select datalist textarea button title"
#: Elements that end a block.
BLOCK = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul"
)
#: Elements that never belong to the text, and those that may hold a whole article.
OUTSIDE = "nav footer aside form menu dialog head"
HOLDERS = "article main"
#: Words in a class, id or role that mark a region as not the text.
MARKS = (
    "ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies copyright disclaimer disqus donate footer gdpr hidden login masthead menu meta modal nav "
    "navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended "
    "related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget widgets"
)
#: Beginnings and ends of a name that tell a state or a topic, not what the element is: has-sidebar, category-ads, comments-open.
STATES = "no not non has have with without category tag type format status overflow layout"
ENDS = "open closed none off enabled disabled layout"
#: Names of a discussion; its articles are never the page's main one.
THREADS = "comment comments comment-list commentlist comments-area comment-body reply replies respond disqus_thread"
#: A header is a page's only outside an article.
PAGE_HEADER = "header"
_RAW, _BLOCK, _OUTSIDE, _HOLDERS, _MARKS = (frozenset(x.split()) for x in (RAW, BLOCK, OUTSIDE, HOLDERS, MARKS))
_STATES, _ENDS, _THREADS = (frozenset(x.split()) for x in (STATES, ENDS, THREADS))
_CONTAINERS = frozenset("article aside body details dialog div fieldset figure footer form header html head li main menu nav ol p section span table td tr ul".split())
_STOP = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}

_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW.split())})\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>{_ATTRIBUTES})>|<[!?/][^>]*>|<[a-zA-Z/!?][^<>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LEGAL = re.compile(r"©|\(c\)\s*\d{4}|\bcopyright\b|\ball rights reserved\b", re.I)
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    outside: bool  # in a region that is never the text
    region: int  # number of the article it stands in; 0 outside any
    heading: bool
    label: bool | None = field(default=None)  # text or not; None while undecided
    marks: tuple[int, ...] = ()  # numbers of the marked elements it stands in


def attributes(rest: str) -> dict[str, str]:
    """Names and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def is_hidden(found: dict[str, str]) -> bool:
    """Not shown: by the attribute itself or by its style."""
    return ("hidden" in found and found["hidden"].lower() != "false") or bool(_UNSEEN.search(found.get("style", "")))


def names(found: dict[str, str]) -> list[str]:
    return [x for a in ("class", "id", "role") if a in found for x in found[a].split()]


def is_marked(found: dict[str, str]) -> bool:
    """A class, id or role names something that is not the text, or readers are told to pass it over."""
    for name in names(found):
        parts = [p.lower() for p in _PARTS.findall(name)]
        if _MARKS.isdisjoint(parts) or ":" in name:
            continue
        if len(parts) == 1 or not (parts[0] in _STATES or parts[-1] in _ENDS):
            return True
    return found.get("aria-hidden", "").lower() == "true"


def is_thread(found: dict[str, str]) -> bool:
    return not _THREADS.isdisjoint(x.lower() for x in names(found))


def blocks(html: str) -> list[Block]:
    """The page cut at block elements, in order; white space is one space, references are decoded.

    A mark counts neither on an article nor on an element that holds the page's longest article; a discussion's
    articles are none.
    """
    out: list[Block] = []
    pieces: list[str] = []
    linked, link_depth, heading, regions = 0, 0, False, 0
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = [("", False, 0, ())]  # element, outside, article, marks
    n_marks, threads = 0, set()
    holders: dict[int, tuple[int, ...]] = {}  # article -> marked elements around it

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, linked, stack[-1][1], stack[-1][2], heading, marks=stack[-1][3]))
            pieces.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            pieces.append(piece)
            if link_depth:
                linked += len(piece.strip())
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag, closing, rest = tag.lower(), bool(m["close"]), m["rest"]
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            link_depth = 0 if closing else 1
        if tag in _BLOCK:
            end_block()
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            link_depth = 0
        if tag not in _CONTAINERS or rest.endswith("/"):
            continue
        if closing:
            # an end tag closes the nearest such element, but no article from inside a paragraph's leftovers
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag == "span":
                        end_block()
                    del stack[i:]
                    break
        else:
            found = attributes(rest) if rest and tag not in ("html", "body") else {}
            hidden, marked = is_hidden(found), is_marked(found)
            thread = is_thread(found)
            _, outside, region, marks = stack[-1]
            if tag in ("p", "li", "span", "td", "tr"):
                if not (hidden or marked):  # these are often left open: only marked ones are followed
                    continue
                end_block()
            elif tag in _HOLDERS:
                marked = thread
                if not outside:
                    regions += 1
                    region = regions
                    if not thread and threads.isdisjoint(marks):
                        holders[region] = marks
            if marked:
                n_marks += 1
                marks = (*marks, n_marks)
                if thread:
                    threads.add(n_marks)
            if hidden or tag in _OUTSIDE or (tag == PAGE_HEADER and not region):
                outside = True
            stack.append((tag, outside, region, marks))
    pieces.append(html[at:])
    end_block()
    sizes = dict.fromkeys(holders, 0)
    for b in out:
        if not b.outside and b.region in sizes:
            sizes[b.region] += len(b.text)
    free = set(holders[max(sizes, key=sizes.get)]) if sizes else set()
    for b in out:
        b.marks = tuple(x for x in b.marks if x not in free)
    return out


def stop_word_share(text: str) -> tuple[float, int]:
    """(largest share of one language's stop words, number of words)."""
    words = _WORDS.findall(text.lower())
    if not words:
        return 0.0, 0
    return max(sum(map(s.__contains__, words)) for s in _STOP.values()) / len(words), len(words)


def first_pass(block: Block) -> bool | None:
    if block.outside:
        return False
    links = block.linked / len(block.text)
    if links > LINKED:
        return False
    if not block.region and len(block.text) < 200 and _LEGAL.search(block.text):
        return False
    if not block.heading and links <= FEW_LINKS:
        share, n = stop_word_share(block.text)
        if n >= ENOUGH_WORDS and share >= DENSE:
            return True
    return None


def second_pass(found: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided block of their region, by characters between;
    before and after alike near, text wins. Where a region has none, an article's blocks are text, and so are
    those of a page on which nothing else is."""
    decided = [b.label for b in found]
    inside = {b.region for b in found if b.region}
    places, at = [], 0
    for b in found:
        places.append((at, at + len(b.text)))
        at += len(b.text) + 1
    near: dict[int, list] = {}
    before: list = [None] * len(found)
    after: list = [None] * len(found)
    for side, order in ((before, range(len(found))), (after, range(len(found) - 1, -1, -1))):
        near.clear()
        for i in order:
            side[i] = near.get(found[i].region)
            if decided[i] is not None and not found[i].outside:
                near[found[i].region] = (decided[i], places[i])
    any_text = any(decided)
    for i, b in enumerate(found):
        if b.label is None:
            options = []
            if before[i]:
                options.append((places[i][0] - before[i][1][1], not before[i][0]))
            if after[i]:
                options.append((after[i][1][0] - places[i][1], not after[i][0]))
            if options:
                b.label = not min(options)[1]
            else:
                b.label = bool(b.region) or not (inside or any_text)


def decide(found: list[Block], marks: bool) -> bool:
    """Labels every block, with or without the marks; whether any is running text or an article's text."""
    for b in found:
        if b.marks and marks:
            b.outside = True
        if b.outside:
            b.region = 0
    for b in found:
        b.label = first_pass(b)
    running = any(b.label for b in found)
    second_pass(found)
    return running or any(b.label and b.region for b in found)


def main_text(html: str) -> str:
    found = blocks(html)
    if any(b.marks and not b.outside for b in found):
        plain = [replace(b) for b in found]
        # marks on all that is running text are names of the page's own text
        if not decide(found, True):
            others = sum(len(b.text) for b in found if b.label)
            if decide(plain, False) and sum(len(b.text) for b in plain if b.marks and first_pass(b)) > others:
                found = plain
    else:
        decide(found, False)
    # blocks outside all articles are not the text of a page whose articles hold most of the text
    within = sum(len(b.text) for b in found if b.label and b.region)
    if 2 * within > sum(len(b.text) for b in found if b.label):
        found = [b for b in found if b.region]
    return "\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame, keep: list[str], html_column: str = "html") -> DataFrame:
    """``keep`` with text and n_chars (code points) of every page.

    A null or empty page gives an empty text. Pages are independent; cut-off, unclosed and wrongly nested markup
    is read as far as it goes. Nothing inside a block of the main text is dropped.
    """
    schema = StructType(
        [pages.schema[c] for c in keep] + [StructField("text", StringType()), StructField("n_chars", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    return in_arrow(pages.select(*keep, pages[html_column].alias("_html_")), run, schema)
