"""Main text of web pages by two passes of block rules.

A page is cut into blocks of text at block-level tags. The first pass judges each block by its
length, the share of its characters inside links and the share of frequent words among its words:
good, bad, or undecided (short, or neither clearly text nor clearly not). Blocks inside elements
that are menus, headers, footers, sidebars, forms and the like by their tag are bad. Names in class,
id or role that speak of such parts, notices, adverts or reader comments count too, unless the
element so named has most of the page's text, as then the name says something about the text and not
what it is. In the second pass undecided blocks take the label of their nearest decided
neighbours; inside an article only neighbours in the article count, and an article in which nothing
is decided is text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.toxicity import FREQUENT

# Element names of the HTML standard, by their part in a page.
RAW = "script style noscript template iframe textarea title xmp noframes noembed".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section select summary table tbody td tfoot th thead tr ul".split()
)
APART = frozenset("aside button dialog fieldset footer form head menu nav search select svg math object canvas audio video datalist".split())
SCOPE = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that tell what an element is for.
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner bottombar breadcrumb breadcrumbs comment comments"
    " complementary consent contentinfo cookie cookies disclaimer discussion disqus dialog footer footnav form gdpr header login"
    " masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall"
    " popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup"
    " skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar widget widgets".split()
)
_STOP = frozenset(w for words in FREQUENT.values() for w in words)
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?:.*?</(?P=raw)\s*[^>]*>|.*\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<(?P<open_end>/?)(?P<open_name>[a-zA-Z][^\s/>]*)(?P<open_rest>[^>]*)>",  # with a quote left open
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass: characters of short and of long blocks, shares of link characters
    and of frequent words."""

    short: int = 70
    long: int = 140
    links: float = 0.5
    frequent: float = 0.2


@dataclass
class Block:
    """``marks``: the elements around it whose names speak against it; ``apart``: one whose tag does."""

    text: str
    linked: int
    apart: bool
    marks: tuple[int, ...]
    scope: int
    heading: bool
    label: str = ""


def _is_apart(name: str, rest: str, inside: int) -> bool:
    """Does the tag itself tell that an element is no text?"""
    if name in APART:
        return True
    if name == "header":
        return not inside
    return name not in ("html", "body") and bool(rest) and bool(_HIDDEN.search(rest))


def _is_marked(name: str, rest: str) -> bool:
    """Do the names of an element speak of something else than text?"""
    if name in SCOPE or name in HEADING or name in ("html", "body") or not rest:
        return False
    words = {w for m in _NAMED.findall(rest) for w in re.split(r"[^a-z]+", m.lower())}
    return bool(words & APART_WORDS)


@dataclass(frozen=True, slots=True)
class _Open:
    name: str
    apart: bool
    marks: tuple[int, ...]
    scope: int
    inline: bool = False


class _Stack:
    """Open elements. End tags find theirs without a search where there is none to be found."""

    def __init__(self):
        self.items = [_Open("", False, (), 0)]
        self.counts = [Counter()]  # of the names opened within each article, outermost first

    @property
    def top(self) -> _Open:
        return self.items[-1]

    def push(self, item: _Open) -> None:
        self.items.append(item)
        self.counts[-1][item.name] += 1
        if item.name in SCOPE:
            self.counts.append(Counter())

    def pop(self) -> None:
        item = self.items.pop()
        if item.name in SCOPE:
            self.counts.pop()
        self.counts[-1][item.name] -= 1

    def end(self, name: str) -> None:
        """Close the nearest element of this name; what was left open inside ends with it. An end tag
        does not reach out of an article, unless it is the article's own or that of the page, and
        that of an inline element not out of a block."""
        inline = name not in BLOCK and name not in APART
        if name in ("body", "html"):
            known = any(c[name] for c in self.counts)
        else:
            known = self.counts[-1][name] or name in SCOPE and any(c[name] for c in self.counts)
        if not known:
            return
        if inline:
            for k in range(len(self.items) - 1, 0, -1):
                if self.items[k].name == name:
                    break
                if not self.items[k].inline:
                    return
        while self.top.name != name:
            self.pop()
        self.pop()

    def next_of(self, name: str) -> None:
        """A paragraph, item or heading ends where the next one begins."""
        for k in range(len(self.items) - 1, 0, -1):
            if self.items[k].name == name:
                while len(self.items) > k:
                    self.pop()
                return
            if not self.items[k].inline:
                return


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, undecided. Elements left open end with their parents."""
    made: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked, links, scopes, marked, breaks, heading = 0, 0, 0, 0, 0, False

    def close() -> None:
        nonlocal linked, heading, breaks
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = stack.top
            made.append(Block(text, linked, top.apart, top.marks, top.scope, heading))
        parts.clear()
        linked, heading, breaks = 0, False, 0

    def add(text: str) -> None:
        nonlocal linked, breaks
        if text:
            parts.append(text)
            if not text.isspace():
                breaks = 0
            if links:
                linked += len(" ".join(html.unescape(text).split()))

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name, rest = (m["name"] or m["open_name"] or "").lower(), m["rest"] or m["open_rest"] or ""
        ends = bool(m["end"] or m["open_end"])
        if not name:
            if m["raw"] and m["raw"].lower() in ("textarea", "title"):
                close()
            continue
        if name == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                close()
            continue
        if name == "a":
            links = max(0, links + (-1 if ends else 1))
        is_block = name in BLOCK or name in APART
        if is_block:
            close()
            links = 0 if name != "a" else links
        if ends:
            before = stack.top
            if not is_block and (before.apart or before.marks):
                # the text of an inline element that is none ends with it
                probe = len(stack.items)
                text, where = list(parts), before
                stack.end(name)
                if len(stack.items) < probe and (stack.top.apart, stack.top.marks) != (where.apart, where.marks):
                    own = " ".join(html.unescape("".join(text)).split())
                    if own:
                        made.append(Block(own, linked, where.apart, where.marks, where.scope, heading))
                    parts.clear()
                    linked, breaks = 0, 0
            else:
                stack.end(name)
        elif name not in VOID:
            if name in ("p", "li", "option", *HEADING):
                stack.next_of(name)
            top = stack.top
            scope = top.scope
            if name in SCOPE and not top.apart:
                scopes += 1
                scope = scopes
            apart, marks = top.apart or _is_apart(name, rest, scope), top.marks
            if _is_marked(name, rest):
                marked += 1
                marks = (*marks, marked)
            if not is_block and (apart, marks) != (top.apart, top.marks):
                close()  # an inline element that is no text
            if not rest.rstrip().endswith("/") or is_block:
                stack.push(_Open(name, apart, marks, scope, not is_block))
        if name in HEADING and not ends:
            heading = True
    add(page[at:])
    close()
    return made


def _names_that_count(made: list[Block]) -> set[int]:
    """Marks of elements that have not most of the page's text (characters outside links)."""
    text, total = Counter(), 0
    for b in made:
        if not b.apart:
            own = max(len(b.text) - b.linked, 0)
            total += own
            for mark in b.marks:
                text[mark] += own
    return {mark for b in made for mark in b.marks if 2 * text[mark] <= total or b.apart}


def judge(made: list[Block], rules: Rules = Rules()) -> list[Block]:
    """Both passes; every block gets the label good or bad."""
    counting = _names_that_count(made)
    for b in made:
        n = len(b.text)
        density = b.linked / n
        words = b.text.lower().split()
        frequent = sum(w.strip(".,;:!?\"'()") in _STOP for w in words) / len(words)
        if b.apart or density > rules.links or not counting.isdisjoint(b.marks):
            b.label = "bad"
        elif not b.scope and ("©" in b.text or "all rights reserved" in b.text.lower()) and n < 2 * rules.long:
            b.label = "bad"
        elif b.heading or n < rules.short:
            b.label = "short"
        elif frequent >= rules.frequent:
            b.label = "good" if n >= rules.long else "near"
        else:
            b.label = "short" if b.scope else ("bad" if n < rules.long or frequent < rules.frequent / 4 else "near")
    first = [b.label for b in made]
    before, after = _decided(made, first, 1), _decided(made, first, -1)
    nothing = not {"good", "bad"} & set(first)
    for i, b in enumerate(made):
        if first[i] in ("good", "bad"):
            continue
        sides = [(abs(i - j), first[j]) if j is not None else None for j in (before[i], after[i])]
        if b.scope or nothing:
            sides = [x for x in sides if x]
            b.label = "good" if not sides else _nearer(sides, first[i], b.heading)
        else:
            b.label = _nearer([sides[0] or (i + 1, "bad"), sides[1] or (len(made) - i, "bad")], first[i], b.heading)
    return made


def _decided(made: list[Block], first: list[str], step: int) -> list[int | None]:
    """For every block the nearest decided one on one side. In an article only its own good blocks
    count, as what is bad there is bad by its own element."""
    last: dict[int, int] = {}
    found: list[int | None] = [None] * len(made)
    for i in range(len(made))[::step]:
        found[i] = last.get(made[i].scope)
        if first[i] in ("good", "bad"):
            last[0] = i
            if first[i] == "good":
                last[made[i].scope] = i
    return found


def _nearer(sides: list[tuple[int, str]], first: str, heading: bool) -> str:
    labels = {label for _, label in sides}
    if len(labels) == 1:
        return labels.pop()
    if first == "near":
        return "good"
    if heading:
        return sides[-1][1]  # a heading goes with what follows it
    return min(sides, key=lambda x: x[0])[1]  # as far on either side: with what comes before


def main_text(page: str, rules: Rules = Rules()) -> str:
    """The main text of a page; a page without tags is text as a whole."""
    return "\n".join(b.text for b in judge(blocks(page), rules) if b.label == "good")


def extract(pages: DataFrame, html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """``pages`` without the html but with text and n_chars; columns of these names give way. A null
    page is an empty one."""
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", rules) for x in batch.column(0)]
            sizes = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), sizes], names=[*batch.schema.names[1:], "text", "n_chars"]
            )

    from pyspark.sql import types as T

    kept = [f for f in pages.schema.fields if f.name in rest]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(F.col(html_col).cast("string").alias("_html"), *rest).mapInArrow(run, schema)
