"""Main text of web pages by two passes of block rules.

A page is cut into blocks at the tags of block elements. What is never main text is left out with all it holds:
scripts, styles, forms, menus, footers, sidebars, hidden elements, and elements whose class, id or role names them as
adverts, notices, comments and the like. A name counts by its first or last part, and not if it says that something has such
a thing (``has-sidebar``, ``comments-open``). An article in a named element is main text all the same, if no article or main
element in fewer named elements has a paragraph. Pass 1 decides blocks by link density, length and the density of stop words; short blocks and
those of few stop words stay open. Pass 2 gives an open block the label of its nearest decided neighbours: within an
article (or main element) it is dropped only if both sides are; elsewhere it is kept only if both sides are. Where
nothing is decided, blocks of an article are kept and others dropped. A page on which stop words make no block good is of
a language that its list doesn't know, or has none: there length and link density alone decide the long blocks.

Stop words are learned by group of pages, that is by the language of the html element and the script most letters are of. A word's share of the
group's pages is drawn towards its share of all pages of the script, which counts as ``PRIOR_PAGES`` pages more; words of at least ``STOP_SHARE`` are the
group's list. So a group of few pages goes by what its script's pages have in common, a large one by its own, and one page more or less changes
shares by little, at every size. Every word of every page counts; a task sends what it has counted when it holds ``HELD_WORDS`` words, and the sums
are taken after that, so the lists don't depend on how the table is cut. A list holds words of its group's pages only, of a group of many pages at most
their mean different words over ``STOP_SHARE``; there are no more lists than names of two or three letters and scripts. They are broadcast, and a page is then
judged on its own, by the list of its group or, if it names no language, by the list of its script that knows most of its different words.

Defined results: null html is empty and gives an empty text, as does a page without text. Character references are
decoded, then every run of space, tab, line feed, vertical tab, form feed and carriage return is one space, blocks are
trimmed and joined by one space in page order. Broken markup is read as browsers do in spirit: an unclosed element
ends with its parent, an unclosed script or comment ends the page. Repeated rows are judged each. Only ``page_id``,
``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.llm import textbytes
from shardframe.llm.shared import received, shipped, text_of, written

STOP_SHARE = 0.05
#: Pages of the whole script that a group's own pages are held against: with this number of its own, both count alike.
PRIOR_PAGES = 60
#: Different words that a task counts before it sends the counts on.
HELD_WORDS = 200_000

#: Blocks of fewer characters are short; of a stop-word density below LOW they are open, at HIGH they are good.
SHORT = 70
LOW, HIGH = 0.2, 0.3
MOST_LINKS = 0.4

# A quoted value that holds a "<" isn't taken as quoted, so that unpaired quotes can't reach across tags.
SPACE = re.compile(r"[\x20\x09-\x0D]+")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|canvas|title|select|xmp|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
PART = re.compile(r"[a-z]+")

HTML = re.compile(r"<html\b([^>]*)", re.IGNORECASE)
LANG = re.compile(r"""(?:^|[\s"'])(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})(?![a-z])""", re.IGNORECASE)
#: First code points of runs of letters, and their scripts; "" is what has no script of its own.
SCRIPTS = {
    0: "", 0x41: "latin", 0x5B: "", 0x61: "latin", 0x7B: "", 0xC0: "latin", 0x2B0: "", 0x370: "greek", 0x400: "cyrillic",
    0x530: "armenian", 0x590: "hebrew", 0x600: "arabic", 0x700: "syriac", 0x750: "arabic", 0x780: "thaana", 0x7C0: "nko",
    0x800: "", 0x8A0: "arabic", 0x900: "devanagari", 0x980: "bengali", 0xA00: "gurmukhi", 0xA80: "gujarati", 0xB00: "oriya",
    0xB80: "tamil", 0xC00: "telugu", 0xC80: "kannada", 0xD00: "malayalam", 0xD80: "sinhala", 0xE00: "thai", 0xE80: "lao",
    0xF00: "tibetan", 0x1000: "myanmar", 0x10A0: "georgian", 0x1100: "hangul", 0x1200: "ethiopic", 0x13A0: "", 0x1780: "khmer",
    0x1800: "mongolian", 0x18B0: "", 0x1C80: "cyrillic", 0x1C90: "georgian", 0x1CC0: "", 0x1E00: "latin", 0x1F00: "greek",
    0x2000: "", 0x3040: "cjk", 0x3130: "hangul", 0x3190: "cjk", 0xA000: "", 0xAC00: "hangul", 0xD800: "", 0xF900: "cjk",
    0xFB00: "latin", 0xFB13: "armenian", 0xFB1D: "hebrew", 0xFB50: "arabic", 0xFE00: "", 0xFE70: "arabic", 0xFEFF: "",
    0x20000: "cjk", 0x32000: "",
}
NAMED = sorted(set(SCRIPTS.values()))

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text.
DROPPED = frozenset("nav footer aside form button menu dialog head datalist audio video map label input".split())
MAIN = frozenset(["article", "main"])
#: Parts of class and id names, and roles, of what is not main text.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar sidenav footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription share sharing social related recommended comment comments commentlist reply replies "
    "respond login signin signup register search toolbar widget widgets pagination pager copyright disclaimer skip tags "
    "contentinfo complementary".split()
)
#: Parts of names that tell what an element has or allows, not what it is.
STATES = frozenset("has have with without no not open opened closed enabled disabled allowed on off".split())
#: Elements that close an open paragraph, and those that only one of can be open in its list or table.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass
class Block:
    """A run of text between block tags: its text, the characters of it in links, its article, and how many elements named
    as boilerplate the article stands in."""

    text: str
    links: int
    main: int
    named: int = 0
    label: int = 0


def _boilerplate(name: str, in_main: bool) -> bool:
    """Whether one class, id or role names what is not main text."""
    parts = PART.findall(name)
    if not parts or not STATES.isdisjoint(parts):
        return False
    ends = {parts[0], parts[-1]}
    return not BOILERPLATE.isdisjoint(ends) or (not in_main and "header" in ends)


def _judged(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool, bool]:
    """Whether an element is never main text, is named as boilerplate, and is an article or main element."""
    never = tag in DROPPED or (tag == "header" and not in_main)
    named, is_main = False, tag in MAIN
    if not attrs:
        return never, False, is_main
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and UNSEEN.search(value):
            never = True
        elif name in ("class", "id", "role"):
            if name == "role" and "main" in value.split():
                is_main = True
            named = named or any(_boilerplate(x, in_main) for x in value.split())
    return never, named and not is_main and tag not in ("html", "body"), is_main


def blocks(page: str) -> list[Block]:
    """The blocks of a page outside what is never main text, in page order."""
    out: list[Block] = []
    in_article: list[bool] = []
    stack: list[tuple[str, bool, bool, tuple[int, int, int]]] = []  # tag, never main text, main, what held before
    banned, main, links, articles = 0, 0, 0, 0
    # Open elements named as boilerplate, outside and inside the outermost article; open article elements.
    outside, inside, nested = 0, 0, 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip(" ")
            if text:
                out.append(Block(text, min(linked, len(text)), articles if main else 0, outside))
                in_article.append(nested > 0)
        parts, linked = [], 0

    def pop() -> None:
        nonlocal banned, main, outside, inside, nested
        tag, was_banned, was_main, (outside, inside, nested) = stack.pop()
        banned -= was_banned
        main -= was_main

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not banned and not inside:
            text = page[at : m.start()]
            parts.append(text)
            if links:
                linked += len(entities.unescape(text).strip())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            if not banned and not inside:
                parts.append(" ")
            continue
        if tag == "a":
            links = 0 if m["close"] else 1
            continue
        block = tag in BLOCKS or tag in DROPPED
        if not block and not m["attrs"]:
            continue
        if m["close"]:
            if any(t[0] == tag for t in reversed(stack)):
                flush()
                if block:
                    links = 0
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif block:
                flush()
            continue
        if block:
            flush()
            links = 0
            # A block element ends an open paragraph; an item ends the item before it.
            if stack and stack[-1][0] == "p":
                pop()
            for like in SIBLINGS.get(tag, ()):
                if stack and stack[-1][0] == like:
                    pop()
        if tag in VOID or m["attrs"].endswith("/") and not block:
            continue
        never, named, is_main = _judged(tag, m["attrs"], main > 0)
        if block or never or named:
            if (never or named) and not block:
                flush()
            stack.append((tag, never, is_main, (outside, inside, nested)))
            banned += never
            inside += named
            if is_main:
                main += 1
                articles += 1
                if not nested:
                    outside, inside = outside + inside, 0
                nested += tag == "article"
    if at < len(page) and not banned and not inside:
        tail = page[at:]
        parts.append(tail)
    flush()
    if all(not b.named for b in out):
        return out
    # The articles in the fewest named elements are the page's own; others are comments, teasers and the like.
    own = [b for b in out if b.main]
    paragraphs = [b for b in own if len(b.text) >= SHORT and b.links <= MOST_LINKS * len(b.text)]
    least = min(b.named for b in paragraphs or [b for b, a in zip(out, in_article) if a] or own)
    return [b for b in out if b.named <= least]


GOOD, OPEN, BAD = 1, 0, -1


def first_pass(b: Block, stop: frozenset[str]) -> int:
    """Good, bad, or open."""
    size = len(b.text)
    if b.links > MOST_LINKS * size:
        return BAD
    if size < SHORT:
        return OPEN
    if not stop:
        return OPEN
    words = b.text.lower().split()
    density = sum(w.strip(".,;:!?\"'()") in stop for w in words) / len(words)
    if density >= HIGH:
        return GOOD
    if b.main:
        return GOOD if density >= LOW else OPEN
    return OPEN if density >= LOW else BAD


def second_pass(page: list[Block]) -> list[bool]:
    """Whether each block is main text; open ones by their nearest decided neighbours in the same article or outside."""
    kept = []
    has_main = any(b.main for b in page)
    before: list[int] = []
    last: dict[int, int] = {}
    for b in page:
        before.append(last.get(b.main, OPEN))
        if b.label:
            last[b.main] = b.label
    last = {}
    after = [OPEN] * len(page)
    for k in range(len(page) - 1, -1, -1):
        after[k] = last.get(page[k].main, OPEN)
        if page[k].label:
            last[page[k].main] = page[k].label
    for b, left, right in zip(page, before, after):
        if has_main and not b.main:
            kept.append(False)  # the page says where its main text is
        elif b.label:
            kept.append(b.label == GOOD)
        elif b.main:
            kept.append(not (left == right == BAD))
        else:
            kept.append(left == right == GOOD)
    return kept


def words_of(found: list[Block]) -> set[str]:
    """The different words of a page's blocks."""
    return {w.strip(".,;:!?\"'()") for b in found for w in b.text.lower().split()} - {""}


def group_of(page: str, found: list[Block]) -> str:
    """The language that a page names, empty if none, a slash, and the script of most of its letters."""
    tag = HTML.search(page)
    lang = LANG.search(tag[1]) if tag else None
    script = "latin"
    if not all(b.text.isascii() for b in found):
        starts = np.fromiter(SCRIPTS, np.uint32)
        numbers = np.array([NAMED.index(x) for x in SCRIPTS.values()])
        letters = np.zeros(len(NAMED), np.int64)
        for b in found:
            points = np.frombuffer(b.text.encode("utf-32-le", "replace"), np.uint32)
            runs = np.bincount(np.searchsorted(starts, points, "right") - 1, minlength=len(starts))
            letters += np.bincount(numbers, weights=runs, minlength=len(NAMED)).astype(np.int64)
        letters[NAMED.index("")] = 0
        if letters.any():
            script = NAMED[int(letters.argmax())]
    return f"{lang[1].lower() if lang else ''}/{script}"


class Lists:
    """The stop words of every group, and which lists of a script know a word."""

    def __init__(self, lists: dict[str, frozenset[str]]):
        self.lists, self.knows = lists, {}
        for name, stop in sorted(lists.items()):
            # Pages that name no language make up no list for others.
            if not name.startswith("/"):
                for word in stop:
                    self.knows.setdefault((name.partition("/")[2], word), []).append(name)

    def of(self, page: str, found: list[Block]) -> frozenset[str]:
        """The stop words that a page is judged by."""
        group = group_of(page, found)
        if not group.startswith("/"):
            return self.lists.get(group, frozenset())
        script = group[1:]
        votes = Counter(name for word in words_of(found) for name in self.knows.get((script, word), ()))
        if not votes:
            return self.lists.get(group, frozenset())
        most = max(votes.values())
        return self.lists[min(name for name, n in votes.items() if n == most)]


def main_text(page: str, stop: frozenset[str] | Lists) -> str:
    """The main text of a page, by one list of stop words or by those of each group."""
    found = blocks(page)
    if isinstance(stop, Lists):
        stop = stop.of(page, found)
    for b in found:
        b.label = first_pass(b, stop)
    if all(b.label != GOOD for b in found):
        for b in found:
            if len(b.text) >= SHORT and b.links <= MOST_LINKS * len(b.text):
                b.label = GOOD
    return " ".join(b.text for b, keep in zip(found, second_pass(found)) if keep)


def stop_lists(pages: DataFrame, html: str = "html") -> dict[str, frozenset[str]]:
    """By group of pages, the words of which at least STOP_SHARE of its pages have, drawn towards the pages of its script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[str]] = {}

        def sent() -> pa.RecordBatch:
            groups = pa.array([g for g, c in counts.items() for _ in c], pa.string())
            words = pa.array([w for c in counts.values() for w in c], pa.string())
            numbers = pa.array([n for c in counts.values() for n in c.values()], pa.int64())
            counts.clear()
            return pa.RecordBatch.from_arrays([groups, words, numbers], names=["name", "word", "n"])

        for batch in batches:
            for part in textbytes.slices(batch, "html"):
                for page in part.column("html").to_pylist():
                    found = blocks(page)
                    # The empty word counts the pages.
                    counts.setdefault(group_of(page, found), Counter()).update(["", *words_of(found)])
                if sum(map(len, counts.values())) >= HELD_WORDS:
                    yield sent()
        yield sent()

    sent = pages.select(text_of(html).alias("html")).mapInArrow(run, "name string, word string, n long")
    counted = written(sent.groupBy("name", "word").agg(F.sum("n").alias("n")), "words")
    script = F.substring_index("name", "/", -1)
    groups = counted.filter("word = ''").select("name", script.alias("script"), F.col("n").alias("pages"))
    alike = groups.groupBy("script").agg(F.sum("pages").alias("all_pages"))
    shared = counted.filter("word <> ''").groupBy(script.alias("script"), "word").agg(F.sum("n").alias("n_all"))
    known = counted.filter("word <> ''").join(written(groups.join(alike, "script"), "groups"), "name").join(written(shared, "shared"), ["script", "word"])
    drawn = F.col("n") + PRIOR_PAGES * F.col("n_all") / F.col("all_pages")
    known = known.filter(drawn >= STOP_SHARE * (F.col("pages") + PRIOR_PAGES))
    lists: dict[str, list[str]] = {}
    for r in known.select("name", "word").collect():
        lists.setdefault(r["name"], []).append(r["word"])
    return {name: frozenset(words) for name, words in lists.items()}


def stop_words(pages: DataFrame, html: str = "html") -> frozenset[str]:
    """The stop words of all groups."""
    return frozenset().union(*stop_lists(pages, html).values())


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    stop = shipped(pages.sparkSession, stop_lists(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lists(received(stop))
        for batch in batches:
            for part in textbytes.slices(batch, "html"):
                texts = [main_text(page, words) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
