"""Main text of web pages by two passes over blocks.

Markup is cut into blocks of text. The first pass classes each block by its own words: link-rich
blocks, and those in parts of a page that by their element or name are menus, adverts, notices,
forms, comments and the like, are bad; long blocks with many stop words are good, shorter ones near
good; long ones with few stop words and no full stop are bad; other blocks of few characters or few stop words stay open. The second pass gives near-good and open
blocks the label of their nearest decided neighbour: of the last and the next good and bad block the one that is fewest
steps away in the tree of containers. So a paragraph goes with its own section rather
than with the menu next to it. At equal distance near-good blocks stay and open ones go. A heading
looks ahead only.

A page's own marks, ``article`` and ``main``, are one feature among these: they settle equal distances, and
where marked text is good, unmarked blocks are near good at best.

Defined cases: a null or empty page, and one without article text, gives an empty text; an unfinished
tag at the end is dropped; unclosed elements end where a browser would end them; character
references are decoded once; quoted attribute values may be of any length; pages of any length are read whole, in batches
bounded by bytes; rows that repeat give repeated rows; an empty table gives an empty one; other columns are ignored
unless named in ``keep``, and kept columns must not be called text or n_chars.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from loomtrace.llm.common import slices, small_batches

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    the of and to a in is it that was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux mais comme ou
    der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    el y los se del las por con para como lo su al más pero sus o este sí porque
    """.split()
)

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Parts of a page that never hold the article.
_AWAY = frozenset("nav footer aside form head script style noscript template button select textarea iframe svg canvas object menu dialog title xmp noembed noframes fieldset label".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsbygoogle|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumb\w*|pagination|pager|toolbar|"
    r"side-?bar\w*|widget\w*|footer|page-?header|site-?header|masthead|top-?bar|comment\w*|disqus\w*|replies|respond|reviews?|related|recommended|share|sharing|social|newsletter|subscribe|signup|login|search)(?:$|[\s_-])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comment\w*|replies|disqus\w*|reviews?)(?:$|[\s_-])", re.I)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: A quote opens a value after an equals sign only. Possessive repeats keep the scan linear.
_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(>|\Z))""", re.S)
#: Elements whose borders set text apart; paragraphs, headings, items and cells follow each other without one.
_CONTAINER = _BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead tfoot hr pre center".split())
_STOP = re.compile(r"[.!?]")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(frozen=True)
class Settings:
    """Characters of short and of long blocks, stop-word shares of near-good blocks, and the largest share of linked characters."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.3
    stop_high: float = 0.32
    links: float = 0.3


@dataclass
class Block:
    text: str
    linked: int
    article: bool
    away: bool
    heading: bool
    #: Containers around it, and the fewest at any place since the block before it.
    depth: int = 0
    low: int = 0
    kind: str = ""


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space as single spaces."""
    found: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    #: Open elements: name, whether it is away from the article, whether it is the article or within it.
    stack: list[tuple[str, bool, bool]] = []
    link, breaks, heading, depth, low = 0, 0, False, 0, 0

    def flush():
        nonlocal breaks, low
        breaks = 0
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                away, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                found.append(Block(whole, len(" ".join(html.unescape("".join(linked)).split())), article, away, heading, depth, low))
                low = depth
            text.clear()
            linked.clear()

    def close(name: str, within: frozenset | None = None) -> None:
        nonlocal depth, low
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                depth -= sum([x[0] in _CONTAINER for x in stack[k:]])
                low = min(low, depth)
                del stack[k:]
                return
            if within is not None and stack[k][0] in within:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        part = page[at : m.start() if m else end]
        if part:
            text.append(part)
            if link:
                linked.append(part)
            if breaks and not part.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        rest, closing = m[4] or "", bool(m[2])
        if not m[5]:
            break  # the page ends within a tag
        if name == "a":
            link = 0 if closing else 1
            continue
        if name == "br":
            breaks += 1
            text.append(" ")
            if breaks > 1:
                flush()
            continue
        block = name in _BLOCK
        if block:
            flush()
        if closing:
            if name in _HEADING:
                heading = False
            if name not in _VOID:
                close(name)
            continue
        if name in _VOID:
            continue
        if name == "body":
            stack.clear()
            depth = low = 0
        elif block:
            link = 0
            close("p", frozenset(_BLOCK - {"p"}))
            if name == "li":
                close("li", frozenset({"ul", "ol", "menu", "dir"}))
            elif name in ("td", "th"):
                close("td", frozenset({"table", "tr"}))
                close("th", frozenset({"table", "tr"}))
            elif name == "tr":
                close("tr", frozenset({"table"}))
            elif name in ("dt", "dd"):
                close("dt", frozenset({"dl"}))
                close("dd", frozenset({"dl"}))
        if name in _RAW:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        heading = name in _HEADING
        names = " ".join(x or y or z for x, y, z in _NAMES.findall(rest)) if "=" in rest else ""
        away, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name in ("article", "main"):
            # A page's article ends what was left open around it; comments may be articles, too.
            away, article = bool(_COMMENT.search(names)) or (article and away), True
        elif not away:
            away = name in _AWAY or (name == "header" and not article) or (name not in ("html", "body") and bool(names and _NAMED.search(names))) or bool(rest and _HIDDEN.search(rest))
        if block or away or article:
            if not rest.endswith("/") or block:
                stack.append((name, away, article))
                depth += name in _CONTAINER
    flush()
    return found


def _first_pass(found: list[Block], s: Settings) -> None:
    """Each block's kind by its own words: good, near, open or bad."""
    for b in found:
        words = b.text.lower().split()
        stops = sum([w.strip(".,;:!?\"'()") in STOP_WORDS for w in words]) / len(words)
        if b.away or b.linked > s.links * len(b.text) or "\u00a9" in b.text[:40] or (len(b.text) < s.short and b.linked and not b.article):
            b.kind = "bad"
        elif len(b.text) >= s.short and stops < s.stop_low and not b.article and not _STOP.search(b.text):
            b.kind = "bad"  # a list of words
        elif len(b.text) < s.short or stops < s.stop_low:
            b.kind = "open"
        else:
            b.kind = "good" if stops >= s.stop_high and len(b.text) > s.long else "near"
    if any(b.kind == "good" and b.article for b in found):
        for b in found:
            if b.kind == "good" and not b.article:
                b.kind = "near"
    # Pages without a long text: what comes closest to one decides.
    for kind, marked in (("good", False), ("near", True), ("near", False), ("open", True), ("open", False)):
        chosen = [b for b in found if b.kind == kind and (b.article or not marked)]
        if chosen:
            if kind == "open" and not marked:
                chosen = [max(chosen, key=lambda b: len(b.text))]
            for b in chosen:
                b.kind = "good"
            break


def _distances(found: list[Block], lows: list[int]) -> list[dict[str, int]]:
    """For each block how many steps the last good and the last bad block before it are away in the tree of containers."""
    out, last = [], {}
    for b, low in zip(found, lows):
        # Two places meet at the fewest containers passed between them.
        last = {kind: (depth, min(least, low)) for kind, (depth, least) in last.items()}
        out.append({kind: b.depth + depth - 2 * least for kind, (depth, least) in last.items()})
        if b.kind in ("good", "bad"):
            last[b.kind] = b.depth, b.depth
    return out


def classify(found: list[Block], s: Settings = Settings()) -> list[Block]:
    """The blocks of the main text."""
    _first_pass(found, s)
    lows = [b.low for b in found]
    before, after = _distances(found, lows), _distances(found[::-1], [0, *lows[:0:-1]])[::-1]
    marked = any(b.article and b.kind == "good" for b in found)
    chosen = []
    for b, left, right in zip(found, before, after):
        keep = b.kind == "good"
        if b.kind in ("near", "open"):
            # A heading belongs to what follows it.
            sides = (right,) if b.heading else (left, right)
            good, bad = (min([x[kind] for x in sides if kind in x], default=None) for kind in ("good", "bad"))
            if good is None or bad is None:
                keep = good is not None
            else:
                keep = good < bad or (good == bad and (b.article or (b.kind == "near" and not marked)))
        if keep:
            chosen.append(b)
    return chosen


def main_text(page: str | None, s: Settings = Settings()) -> str:
    return "\n".join([b.text for b in classify(blocks(page), s)]) if page else ""


def extract(pages: DataFrame, keep: list[str], markup: str = "html", s: Settings = Settings()) -> DataFrame:
    """The columns ``keep``, then text and n_chars, of every page."""
    small_batches(pages.sparkSession)
    if {c.lower() for c in keep} & {"text", "n_chars"}:
        raise ValueError("columns to keep must not be called text or n_chars")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_page"):
            texts = [main_text(t, s) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, pages[markup].alias("_page")).mapInArrow(run, f"{fields}, text string, n_chars long")
