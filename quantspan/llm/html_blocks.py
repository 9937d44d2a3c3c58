"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one per block element. A line weighs its characters outside
links; lines in menus, footers, forms, adverts, comments and the like weigh nothing, nor do
lines outside the article where the page marks one. Sums over a sliding window of lines rise
where the text surges and fall to nothing where it dives; what lies between a surge and the
next dive is kept if the sums reach far enough.

Defined results: null, empty and text-free pages give "" and 0. Unclosed elements are not
trusted to be containers; an unclosed script or style runs to the end of the page.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.llm.batches import arrow_map, fresh, pick

BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
SPACES = {"br", "td", "th", "img", "input"}
BOILERPLATE_TAGS = {"nav", "aside", "footer", "form", "button", "menu", "dialog", "fieldset", "dir"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar", "toolbar"}
BOILERPLATE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner billboard breadcrumb breadcrumbs "
    "byline captcha comment comments commentary consent cookie cookies copyright disqus discussion feedback foot "
    "footer form gdpr header legal login masthead menu menubar message modal nav navbar navigation navi newsletter "
    "notice notices notification outbrain overlay pager paging pagination popup promo promoted promotion register "
    "related recommend recommended recommendations reply replies respond responses search share sharing shoutbox "
    "sidebar side sidenav signup skip social sponsor sponsored subscribe subscription taboola tags teaser toolbar "
    "topbar tracking trending widget widgets".split()
)
PAGE_HEADS = {"header", "masthead", "byline", "message"}  # inside an article these are part of it
RAW = "script|style|title|textarea|iframe|object|canvas|noembed|noframes"
NESTED = "noscript|template|svg|math|select|audio|video|map"

_DROPPED = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    rf"|<({RAW}|{NESTED})\b[^>]*+>.*?</\2\s*>|<!\[CDATA\[|\]\]>|<[!?][^>]*+>",
    re.I | re.S,
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+|[^<>]*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")


@dataclass(frozen=True)
class Settings:
    window: int = 3  # lines
    # Outside a marked article the sums of a region must reach:
    surge: int = 80  # characters, or the largest sum of a page that has less
    share: float = 0.2  # of the largest sum of the page


@dataclass
class Line:
    text: str
    weight: int
    core: bool


def _container(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it marks the article."""
    core = tag in ("article", "main")
    bad = tag in BOILERPLATE_TAGS or (tag == "header" and not inside)
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                words = {w.lower() for w in _NAMES.findall(value)}
                hit = words & BOILERPLATE_NAMES
                if inside or core:
                    hit = hit - PAGE_HEADS
                if hit and tag not in ("body", "html", "main"):
                    bad = True
            elif name == "role":
                bad |= value.lower() in BOILERPLATE_ROLES
                core |= value.lower() in ("main", "article")
            elif name == "itemprop":
                core |= value.lower() == "articlebody"
                bad |= value.lower() == "comment"
            elif name == "style":
                bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name == "hidden":
                bad = True
            elif name == "aria-hidden":
                bad |= value.lower() == "true"
    return bad, core and not bad


def lines(page: str) -> list[Line]:
    """The page's lines of text in order, with their weights."""
    page = _DROPPED.sub(lambda m: "" if m[0][:3] in ("<![", "]]>") else " " if m[1] or m[2] else "", page)
    tags = list(_TAG.finditer(page))
    # The closing tag of each element; -1 for one that is never closed.
    closed = [-1] * len(tags)
    waiting: dict[str, list[int]] = {}
    for i, m in enumerate(tags):
        name = m[2].lower()
        if not m[1]:
            waiting.setdefault(name, []).append(i)
        elif waiting.get(name):
            closed[waiting[name].pop()] = i
    out: list[Line] = []
    parts: list[str] = []
    bad_until = core_until = link_until = -1
    plain = 0
    spoiled = False

    def flush():
        nonlocal parts, plain
        text = " ".join("".join(parts).split())
        if text:
            out.append(Line(text, 0 if spoiled else plain, core))
        parts, plain = [], 0

    core = False
    at = 0
    for i, m in enumerate([*tags, None]):
        chunk = page[at : m.start() if m else len(page)]
        if chunk:
            chunk = entities.unescape(chunk) if "&" in chunk else chunk
            parts.append(chunk)
            if i > link_until:
                plain += len("".join(chunk.split()))
        if m is None:
            break
        at = m.end()
        name = m[2].lower()
        if name in SPACES:
            parts.append(" ")
            continue
        if name == "a":
            if not m[1] and closed[i] > 0:
                link_until = closed[i]
            elif m[1] and i >= link_until:
                link_until = -1
            if m[1] or closed[i] < 0:
                continue
        block = name in BLOCKS
        if block:
            flush()
            if i > bad_until:
                spoiled = False
            if i > core_until:
                core = False
        if m[1]:
            if not block and i == bad_until:
                flush()
                spoiled = False
            continue
        bad, marks = _container(name, m[3], core)
        if bad and i > bad_until:
            if not block:
                flush()
            spoiled = True
            bad_until = closed[i] if closed[i] > 0 else i
        elif marks and not core and closed[i] > 0:
            core, core_until = True, closed[i]
    flush()
    return out


def main_text(page: str | None, s: Settings = Settings()) -> str:
    found = lines(page or "")
    marked = any(x.core and x.weight for x in found)
    weight = [x.weight if x.core or not marked else 0 for x in found]
    sums = [sum(weight[k : k + s.window]) for k in range(len(weight))]
    most = max(sums, default=0)
    least = 1 if marked else max(min(s.surge, most), s.share * most)
    kept: list[str] = []
    k = 0
    while k < len(sums):
        if not sums[k]:
            k += 1
            continue
        dive = k
        while dive < len(sums) and sums[dive]:
            dive += 1
        region = range(k, min(len(weight), dive + s.window - 1))
        if max(sums[k:dive]) >= least:
            kept += [found[i].text for i in region if weight[i]]
        k = region.stop
    return "\n\n".join(kept)


def extract(pages: DataFrame, html: str = "html", s: Settings = Settings()) -> DataFrame:
    """-> the other columns of `pages`, text, n_chars; columns with these names are dropped."""
    column = fresh(pages, "html_to_read")
    kept = {c: c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars")}
    run = lambda texts: {"text": pa.array([main_text(t, s) for t in texts], pa.string())}
    read = arrow_map(pick(pages, **kept, **{column: html}), run, "text string", column)
    return read.withColumn("n_chars", F.length("text").cast("long"))
