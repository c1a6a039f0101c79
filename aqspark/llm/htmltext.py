"""Main text of web pages by line-block distribution.

Markup is stripped first: tags that make blocks end a line, elements that never
hold main text (menus, footers, forms, scripts, advertisements, comments, ...)
become blank lines, which part the text unless it goes on in the container they
stood in, and so does everything outside ``<article>`` or ``<main>`` where a
page has them. Classes and ids hint at such elements by whole names, last words
or first words before a word like ``box``; an element that holds most of the
page's text (nearly all, where the whole name is a hint) is never taken out. Over the lines, the text lengths of each ``WIDTH``
consecutive lines are summed. A surge is a block whose sum reaches ``SURGE`` of
the page's densest block (or ``SURGE_CHARS``, if that is less); the text runs
back to where its blocks begin and on to the dive, the first block without any
text. All text between surges and their dives is kept, in page order.

Defined results: null html is empty; a page without text gives an empty string;
unclosed elements end with the element around them; equal rows give equal rows.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.llm.common import map_batches

WIDTH = 3
SURGE = 0.25
SURGE_CHARS = 80

# fixed values: elements whose content is never text of the page
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select")
# fixed values: elements around the main text
SKIPPED = frozenset("nav aside form footer button dialog menu head".split())
LANDMARKS = frozenset(("article", "main"))
# fixed values: elements that start and end a block
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: words in class, id or role of elements around the main text
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar aside widget widgets related recommended share sharing social comment comments disqus replies respond footer masthead "
    "login signup signin pagination pager toolbar copyright contentinfo complementary search".split()
)
# fixed values: classes of articles that are not main text
ARTICLE_HINTS = frozenset("comment reply ad advert promo sponsored related teaser".split())
ENDED = frozenset(("title", "head"))
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HINT_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# fixed values: first words of names that tell of an element's state, and words after a hint that name a container
STATES = frozenset("has no not with without is hide hides show shows enable disable".split())
CONTAINERS = frozenset(
    "area bar bars block box button buttons column container content form group holder icons inner left right top bottom link links list "
    "main message module panel primary region secondary section slot thread unit wrap wrapper".split()
)
MOST, NEARLY_ALL = 0.5, 0.9  # of the page's text, in elements hinted at by part of a name or by a whole name
GAP = ""  # a blank line


def hinted(value: str) -> float:
    """0, or the share of the page's text from which an element of this class, id or role is kept all the same."""
    share = 0.0
    for token in value.split():
        words = [w.lower() for w in HINT_WORDS.findall(token)]
        if not words or words[0] in STATES:
            continue
        if len(words) == 1 and words[0] in HINTS:
            share = NEARLY_ALL
        elif words[-1] in HINTS or words[0] in HINTS and words[1] in CONTAINERS:
            share = share or MOST
    return share


def around(name: str, attrs: str, in_landmark: bool) -> float:
    """Whether an element stands around the main text: 0, 2 (always), or a share as in ``hinted``."""
    if name in SKIPPED or name == "header" and not in_landmark:
        return 2.0
    if not attrs or name in ("body", "html"):
        return 0.0
    if name in LANDMARKS:  # articles often name their surroundings, so whole classes count
        return 2.0 * any(not ARTICLE_HINTS.isdisjoint(v.strip("\"'").lower().split()) for k, v in ATTRIBUTE.findall(attrs) if k.lower() == "class")
    share = 0.0
    for key, value in ATTRIBUTE.findall(attrs):
        value = value.strip("\"'")
        if key.lower() in ("class", "id", "role"):
            share = max(share, hinted(value))
        elif key.lower() == "style" and re.search(r"display\s*:\s*none", value, re.I) or key.lower() == "aria-hidden" and value.lower() == "true":
            return 2.0
    return share


class Element:
    """An open element: whether it is left out, and what had been read when it opened."""

    __slots__ = ("name", "out", "share", "at", "chars", "hard", "lines")

    def __init__(self, name: str, out: bool, share: float, at: int, chars: int, hard: int, lines: int) -> None:
        self.name, self.out, self.share, self.at, self.chars, self.hard, self.lines = name, out, share, at, chars, hard, lines


def lines(page: str) -> list[tuple[str, bool]]:
    """Text lines of a page and whether each lies in an article, with blank lines where something was taken out."""
    out, large = _lines(page, frozenset())
    return _lines(page, large)[0] if large else out


def _lines(page: str, kept: frozenset[int]) -> tuple[list[tuple[str, bool]], frozenset[int]]:
    """The lines, where the elements that start at ``kept`` are not taken out, and the hinted elements that hold too much text for that."""
    out: list[tuple[str, bool]] = []
    open_names: list[Element] = []
    skipping = landmark = at = hard = chars = n_lines = 0  # hard: open elements that are always left out; chars: read outside them
    here: list[str] = []
    hints: list[tuple[int, float, int]] = []  # start, share and characters of hinted elements
    gaps: list[tuple[int, Element | None, bool]] = []  # depth and element around what was taken out, whether text stood in it
    last: tuple[Element | None, Element | None] = (None, None)  # elements around the last line

    def parents() -> tuple[Element | None, Element | None]:
        return (open_names[-1] if open_names else None, open_names[-2] if len(open_names) > 1 else None)

    def goes_on(depth: int, box: Element | None, before: bool, now: tuple) -> bool:
        if not before or box is not None and (len(open_names) < depth or open_names[depth - 1] is not box):
            return False
        return box is not None and box.name not in ("body", "html") or box in last and box in now

    def end_line() -> None:
        nonlocal last, n_lines
        text = " ".join(entities.unescape("".join(here)).split())
        here.clear()
        if text:
            now = parents()
            if gaps:
                out.extend([(GAP, False)] * (1 if all(goes_on(*g, now) for g in gaps) else WIDTH))
                gaps.clear()
            last, n_lines = now, n_lines + 1
            out.append((text, landmark > 0))

    def gap(taken: bool = True) -> None:
        end_line()
        if not landmark and taken:
            box = open_names[-1] if open_names else None
            gaps.append((len(open_names), box, n_lines > (box.lines if box else 0)))
        elif not landmark:
            gaps.clear()
            out.extend([(GAP, False)] * WIDTH)
        elif not out or out[-1] != (GAP, True):  # what is taken out of an article does not part it
            out.append((GAP, True))

    def leave(name: str) -> None:
        nonlocal skipping, landmark, hard
        for k in range(len(open_names) - 1, -1, -1):
            if open_names[k].name == name:
                break
            if open_names[k].name in LANDMARKS and name not in ("body", "html"):
                return  # a stray end tag does not close the article around it
        else:
            return
        end_line()
        for e in open_names[k:]:
            close(e)
            skipping -= e.out
            if e.name in LANDMARKS and not e.out:
                landmark -= 1
        del open_names[k:]
        if name in LANDMARKS:
            gap(taken=False)

    def close(e: Element) -> None:
        nonlocal hard
        hard -= e.hard
        if 0 < e.share < 2:
            hints.append((e.at, e.share, chars - e.chars))

    def enter(name: str, left_out: bool, share: float, start: int) -> None:
        nonlocal skipping, hard
        always = int(share == 2)
        open_names.append(Element(name, left_out, share, start, chars, always, n_lines))
        skipping += left_out
        hard += always

    for m in TAG.finditer(page):
        read = page[at : m.start()]
        if not hard:
            chars += len("".join(read.split()))
        if not skipping:
            here.append(read)
        at = m.end()
        if m["name"] is None:  # a comment, a declaration or an element without text
            continue
        name, block = m["name"].lower(), m["name"].lower() in BLOCKS | SKIPPED | ENDED
        known = any(e.name == name for e in open_names)
        if m["close"]:
            if block or known:
                leave(name)
            continue
        if name in VOID:
            if name == "hr":
                end_line()
            elif name == "br":
                here.append(" ")
            continue
        if not block:
            share = around(name, m["attrs"], landmark > 0) if m["attrs"] else 0.0
            left_out = share > 0 and not skipping and m.start() not in kept
            if left_out:
                gap()
            if share or known:  # inner elements of the same name must end first
                enter(name, left_out, share, m.start())
            continue
        if open_names and open_names[-1].name == name and name in ("p", "li", "dt", "dd", "tr", "td", "th"):
            leave(name)  # these end where the next one starts
        if name == "body":
            leave("head")
        share = 2.0 if name in ENDED else around(name, m["attrs"], landmark > 0)
        left_out = share > 0 and m.start() not in kept
        if name in LANDMARKS and not left_out and skipping and not landmark:
            # an element left open before the article ends here
            for e in open_names:
                e.out, e.hard = False, 0
            skipping = hard = 0
        if left_out and not skipping:
            gap()
        end_line()
        enter(name, left_out, share, m.start())
        if name in LANDMARKS and not left_out:
            gap(taken=False)
            landmark += 1
    if not hard:
        chars += len("".join(page[at:].split()))
    if not skipping:
        here.append(page[at:])
    end_line()
    for e in open_names:
        close(e)
    return out, frozenset(start for start, share, n in hints if n > share * chars and start not in kept)


def landmark_lines(page: str) -> list[str]:
    """``lines``, with all that lies outside articles blank where a page has articles."""
    found = lines(page)
    if any(inside for _, inside in found):
        return [x if inside else GAP for x, inside in found]
    return [x for x, _ in found]


def main_text(page: str | None) -> str:
    """The kept lines, joined by a line feed."""
    found = landmark_lines(page) if page else []
    if not found:
        return ""
    sizes = [len(x) for x in found]
    sums = [sum(sizes[k : k + WIDTH]) for k in range(len(sizes))]
    surge = min(SURGE_CHARS, max(1, SURGE * max(sums)))
    kept: list[str] = []
    at = 0
    while at < len(sums):
        if sums[at] == 0:
            at += 1
            continue
        dive = next((k for k in range(at, len(sums)) if sums[k] == 0), len(sums))
        if max(sums[at:dive]) >= surge:
            kept += [x for x in found[at:dive] if x]
        at = dive
    return "\n".join(kept)


def extract(df: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``df`` without ``html``, with column ``name``; other columns stay (one called ``name`` is replaced)."""
    rest = [c for c in df.columns if c not in (html, name)]
    rows = df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{html}`").cast("string").alias("_html"))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), f"`{name}` string"])

    def run(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(k) for k, c in enumerate(rest)}
        return out | {name: pa.array([main_text(t.as_py()) for t in batch.column(len(rest))], pa.string())}

    return map_batches(rows, schema, run)
