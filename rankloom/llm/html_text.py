"""Main text of HTML pages by the distribution of line lengths.

Markup is stripped to one line per block; menus, headers, footers, asides,
forms and scripts leave with their elements.  A line's length counts the text
outside links, or nothing if most of it is links.  Names shift lengths: what
lies in a container called after adverts, comments and the like counts nothing,
and where elements call themselves the article, the lines of the one that holds
most text gain, and those elsewhere lose, the more the larger its part of the
page is.  So a page is never decided by a name alone: a small teaser marked as
an article neither gains much nor takes much from a long text beside it.

The lengths are summed over a sliding window of lines: the text starts where
the sum surges over a bound (40, or half the greatest sum of a page with less)
and ends where it dives to nothing, and all lines in between are kept, but
those that only lose by their place.  Pages are worked on one by one, without
any shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import python_workers
#: lines in a window, and the characters that a surge takes
WINDOW, SURGE = 3, 40

#: a quote opens a value only after an equals sign; elsewhere it is a letter like any other, as in browsers
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")

# fixed values: elements and names
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe xmp template".split())
DROPPED = frozenset(
    "aside button datalist dialog footer form head header iframe input label menu nav noscript object script select style svg template "
    "textarea title canvas audio video".split()
)
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies "
    "disclaimer discussion disqus feedback footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promotion rail recommended related replies reply respond search share sharing sidebar sidenav "
    "signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
ARTICLE = frozenset(
    "article article-body article-content articlebody content content-body entry entry-content main main-content maincontent post post-body "
    "post-content story story-body story-content".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WITH = frozenset("with has no without".split())
GENERIC = frozenset("area block body box container content form group holder inner item items list outer panel section thread wrap wrapper".split())
#: names that also tell on a paragraph or heading, where other names may just describe the text
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adslot adsense byline captcha consent cookie cookies newsletter promo promotion share sharing sponsor sponsored".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre span b i em strong a li dt dd td th".split())


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(text)}


def stem(part: str) -> str:
    """A part of a name without a general word at its end: ``commentlist`` is about comments."""
    for word in GENERIC:
        if part.endswith(word) and part[: -len(word)] in NAMED:
            return part[: -len(word)]
    return part


def boilerplate(name: str, names: frozenset[str] = NAMED) -> bool:
    """Whether a class or id names something beside the article, by its first part or the last that says something."""
    parts = [stem(p.lower()) for p in PART.findall(name)]
    while len(parts) > 1 and parts[-1] in GENERIC:
        parts.pop()
    return bool(parts) and parts[0] not in WITH and (parts[0] in names or parts[-1] in names)


def role_of(tag: str, text: str) -> str:
    """'out' for what is dropped, 'in' for what names the article, else ''."""
    if tag in DROPPED:
        return "out"
    found = attributes(text) if text.strip(" \t\r\n/") else {}
    if not found or tag in ("html", "body"):
        return "in" if tag in ("article", "main") else ""
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    if hidden or found.get("role", "").lower() in ROLES:
        return "out"
    if tag in TEXTUAL:
        whole = [n for n in names if len(PART.findall(n)) == 1 or n.lower().startswith(("ad-", "ad_", "ads-", "ads_"))]
        return "out" if any(boilerplate(n, STRONG) for n in whole) else ""
    if tag not in ("article", "main") and any(map(boilerplate, names)):
        return "out"
    if tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") or found.get("itemprop") == "articleBody":
        return "in"
    return "in" if any(n.lower() in ARTICLE for n in names) else ""


def page_lines(page: str) -> list[tuple[str, int, int, bool]]:
    """(text, length, group, title) of every block that is not dropped.

    The group is the number of the outermost element around it that calls
    itself the article, or 0; a title lies in an h1.
    """
    lines: list[tuple[str, int, int, bool]] = []
    text: list[str] = []
    state = {"linked": 0, "out": 0, "in": 0, "a": 0, "group": 0}
    stack: list[tuple[str, str]] = []
    held: dict[str, int] = {}

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                own = len(line) - state["linked"]
                lines.append((line, own if own * 2 > len(line) else 0, state["group"] if state["in"] else 0, held.get("h1", 0) > 0))
            text.clear()
        state["linked"] = 0

    def add(piece: str) -> None:
        if piece and not state["out"]:
            text.append(piece)
            if state["a"]:
                state["linked"] += len(piece.strip())

    def close(tag: str) -> None:
        while stack:
            last, kind = stack.pop()
            held[last] -= 1
            if kind:
                flush()
                state[kind] -= 1
            state["a"] -= last == "a"
            if last == tag:
                return

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()  # before the element is left
            if held.get(tag):
                close(tag)
            continue
        if tag in BLOCKS:
            flush()
        if tag in RAW:
            found = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in ("article", "main") and state["out"] and not held.get(tag):
            # an element that was never closed does not swallow the article
            while stack and state["out"]:
                close(stack[-1][0])
        kind = role_of(tag, m[3])
        if tag == "header" and state["in"]:
            kind = ""
        if tag == "p" and stack and stack[-1][0] == "p":
            close("p")
        if kind:
            flush()
            state["group"] += kind == "in" and not state["in"]
            state[kind] += 1
        stack.append((tag, kind))
        held[tag] = held.get(tag, 0) + 1
        state["a"] += tag == "a"
    flush()
    return lines


def line_weights(lines: list[tuple[str, int, int, bool]]) -> list[float]:
    """Lengths shifted by how much of the text the group of each line holds.

    The lines of the greatest group gain, if it has a name, up to the bound;
    those of others lose the bound times the ratio of both groups.
    """
    mass: dict[int, int] = {}
    for _, n, group, _ in lines:
        mass[group] = mass.get(group, 0) + n
    best = max(mass, key=lambda g: (mass[g], g), default=0)
    rest = sum(mass.values()) - mass.get(best, 0)
    gain = (min(SURGE + 1, SURGE * mass[best] / rest) if rest else SURGE + 1) if best else 0
    loss = {g: SURGE * mass[best] / m if m else 0 for g, m in mass.items()}
    return [(n + gain if group == best else max(0.0, n - loss[group])) if n else 0.0 for _, n, group, _ in lines]


def text_between(lines: list[tuple[str, int, int, bool]]) -> list[str]:
    """The lines from each surge of the window sums to the dive after it.

    A surge with the page's title in its window starts at the title.
    """
    weights = line_weights(lines)
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(lines))]
    bound = min(SURGE, max(sums, default=0) / 2)
    title = next((i for i, line in enumerate(lines) if line[3]), -1)
    kept, inside, surge = [], False, False
    for i, (line, n, group, _) in enumerate(lines):
        if inside and sums[i] == 0:
            inside = False
        elif not inside and weights[i] and (sums[i] > bound or (surge and i == title)):
            surge = True
            inside = group > 0 or not i < title < i + WINDOW
        if inside and (weights[i] or not n):
            kept.append((i, line))
    # lines of nothing but links count only between lines of text
    last = max((i for i, _ in kept if weights[i]), default=-1)
    return [line for i, line in kept if i <= last]


def main_text(page: str | None) -> str:
    return "\n".join(text_between(page_lines(page or "")))


def extract_pages(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` but the html, with the main text added.

    A null, empty or blank page, or one without main text, has an empty text.
    A column already called like the output is replaced.
    """
    python_workers(pages.sparkSession)
    kept = [c for c in pages.columns if c.lower() not in (html_column.lower(), out.lower())]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*[F.col(f"`{c}`") for c in kept]).schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(page.as_py()) for page in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], text], [*kept, out])

    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{html_column}`"), F.lit("")).alias("_html"))
    return rows.mapInArrow(work, f"{schema}, `{out}` string" if schema else f"`{out}` string")
