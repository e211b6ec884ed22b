"""Main text of web pages by line-block distribution.

A page is turned into lines of visible text: comments, scripts, styles and other unseen
elements go, each block element begins a line, and each line keeps its text length and how
much of it stands in links or in elements that frame an article (menus, headers, footers,
side bars, notices, adverts, forms, reader comments). The weight of a line is its length
outside of those. Weights are summed over sliding windows of ``block`` lines; the text
begins where the sums surge to ``surge`` characters (a third of the page's largest sum, if
that is less) and ends where they dive below. Framed
lines are left out first, so that they neither end a run nor stand in one. Every run that
reads as text is kept, whole from its first to its last weighty line, lines of links between
those included: a run with a long line or the end of a sentence outside of links, and in any
case the heaviest. An article or main element only adds the length of its links to the weight
of its lines. Copyright lines at the end, outside of such elements, go.

Elements frame by their kind, or by words of their class, id or role. The words do not count
on html, body, article and main, nor on an element that has a h1, main or (unmarked) article
in it and holds half of the page's unframed text or more: that is the page, not its frame.

Defined results: null, empty and tag-free html give the empty text or their own lines;
unclosed tags end with the page; broken references stay as they are; texts of any length
are read whole; repeated rows and ids are extracted one by one; an empty table gives an
empty result. Columns of the input other than the html pass through; where one is named text
or n_chars, the operator's own gets an underscore appended.
"""

from __future__ import annotations

import html as stdlib_html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import free_name, ship

# HTML elements by their part in a page.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea".split())
FRAMES = frozenset("nav header footer aside form menu dialog button".split())
HOLDERS = frozenset("article main".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag does not reach beyond when it ends an open element of its kind.
_WALLS = HOLDERS | FRAMES | frozenset("div section ul ol dl table".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the same kind ends.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: Words of class, id and role values that name a frame.
FRAME_WORDS = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notification popup modal newsletter subscribe signup share sharing social comment comments disqus respond replies related recommended sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead toolbar login search complementary contentinfo".split())
#: A line with that many characters outside of links reads as text, as does one that ends a sentence.
RUNNING = 40
#: Characters that a window of lines must have to belong to the text.
SURGE = 12
#: Elements whose class words say something of the page, not of the element.
WHOLE = frozenset("html body article main".split())
SENTENCE_ENDS = tuple(".!?…。！？۔।")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_COPYRIGHT = re.compile(r"©|\(c\)\s|copyright\s+(?:©|\(c\)|\d)", re.I)


@dataclass
class Line:
    text: str
    framed: bool
    held: int
    links: int


def _frames(attrs: str) -> tuple[bool, bool]:
    """Whether attributes hide an element, and whether their words name a frame."""
    hidden = named = False
    for k, v in _ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'").lower()
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none", v)):
            hidden = True
        if k in ("class", "id", "role") and not FRAME_WORDS.isdisjoint(_WORD.findall(v)):
            named = True
    return hidden, named


def page_lines(page: str) -> list[Line]:
    """Visible lines of a page in order."""
    out: list[tuple[str, bool, tuple[int, ...], int, int]] = []  # text, framed for sure, named frames around it, holder, link length
    parts: list[str] = []
    links = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # element, whether it frames for sure, whether it is a named frame, whether it holds
    many: Counter[str] = Counter()  # open elements by kind
    named: list[int] = []  # open named frames
    around: set[int] = set()  # named frames with a h1, main or article in them
    framed = held = holder = in_link = n_named = 0

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((text, framed > 0, tuple(named), holder if held else 0, min(links, len(text))))
        parts.clear()
        links = 0

    def pop() -> None:
        nonlocal framed, held, in_link
        name, frames, names, holds = stack.pop()
        many[name] -= 1
        framed -= frames
        held -= holds
        if names:
            named.pop()
        in_link -= name == "a"

    def said(raw: str) -> None:
        nonlocal links
        t = stdlib_html.unescape(raw)
        parts.append(t)
        if in_link:
            links += len(t.strip())

    at = 0
    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            said(page[at:])
            break
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if many[name]:
                if name in BLOCKS:
                    flush()
                while stack[-1][0] != name:
                    if stack[-1][0] in BLOCKS:
                        flush()
                    pop()
                pop()
            elif name in BLOCKS:
                flush()
            continue
        if name in UNSEEN and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else (n if name not in ("head", "title") else at)
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        if name in SELF_CLOSING and many[name]:
            k = len(stack) - 1
            while stack[k][0] != name and stack[k][0] not in _WALLS:
                k -= 1
            if stack[k][0] == name:
                while len(stack) > k:
                    pop()
        hidden, marked = _frames(m[3])
        if name in ("h1", "main") or (name == "article" and not marked):
            around.update(named)
        frames = hidden or (name in FRAMES and not (name == "header" and held > 0))
        names = marked and name not in WHOLE
        holds = name in HOLDERS and not framed
        if holds and not held:
            holder += 1
        stack.append((name, frames, names, holds))
        many[name] += 1
        framed += frames
        held += holds
        if names:
            named.append(n_named)
            n_named += 1
        in_link += name == "a"
    flush()
    whole = sum(len(x[0]) for x in out if not x[1])
    inside: Counter[int] = Counter()
    for text, sure, frames_, _, _ in out:
        for k in frames_ if not sure else ():
            inside[k] += len(text)
    page_itself = {k for k in around if 2 * inside[k] >= whole}
    return [Line(text, sure or any(k not in page_itself for k in frames_), place, link) for text, sure, frames_, place, link in out]


def line_blocks(weights: list[int], block: int) -> list[int]:
    """Sum of each window of ``block`` lines that begins at a line."""
    sums, now = [], sum(weights[:block])
    for i in range(len(weights)):
        sums.append(now)
        now += (weights[i + block] if i + block < len(weights) else 0) - weights[i]
    return sums


def _reads(line: Line) -> bool:
    """Whether a line reads as running text outside of its links."""
    own = len(line.text) - line.links
    return own >= RUNNING or (own > 0 and line.text.endswith(SENTENCE_ENDS))


def text_runs(weights: list[int], block: int, surge: int) -> list[tuple[int, int]]:
    """(begin, end) of the lines between surge and dive, from the first to the last weighty one."""
    sums = line_blocks(weights, block)
    least = max(1, min(surge, max(sums, default=0) // 3))
    runs: list[tuple[int, int]] = []
    i, n = 0, len(weights)
    while i < n:
        if sums[i] < least:
            i += 1
            continue
        j = i
        while j < n and sums[j] >= least:
            j += 1
        inside = [k for k in range(max(i, runs[-1][1] if runs else 0), min(n, j + block - 1)) if weights[k] > 0]
        if inside:
            runs.append((inside[0], inside[-1] + 1))
        i = j
    return runs


def main_text(page: str | None, block: int = 3, surge: int = SURGE) -> str:
    """The article's lines joined by newlines; see the module's text."""
    if not page:
        return ""
    lines = [x for x in page_lines(page) if not x.framed]  # what frames is bridged
    weights = [len(x.text) if x.held else max(0, len(x.text) - x.links) for x in lines]
    runs = text_runs(weights, block, surge)
    heaviest = max(runs, key=lambda r: sum(weights[r[0] : r[1]]), default=None)
    kept = [x for r in runs if r is heaviest or any(_reads(x) for x in lines[r[0] : r[1]]) for x in lines[r[0] : r[1]]]
    while kept and not kept[-1].held and _COPYRIGHT.match(kept[-1].text):
        kept.pop()
    return "\n".join(x.text for x in kept)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with text (string) and n_chars (long) added."""
    ship(pages.sparkSession)
    keep = [f for f in pages.schema if f.name != html]
    picked = pages.select(*[f"`{f.name}`" for f in keep], html)
    text, chars = (free_name(c, [f.name for f in keep]) for c in ("text", "n_chars"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{text}` string", f"`{chars}` long"])
    names = [*(f.name for f in keep), text, chars]

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return picked.mapInArrow(run, schema)
