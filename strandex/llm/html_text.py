"""HTML extraction by consensus host paths.

Each page's containers are scored by the running text in them, without what is plainly no article (menus, footers, forms,
adverts, comments: by tag, class and id).  The page votes for the generalised path (tags with classes, numbers blurred)
of its best container.  Spark adds the votes of a host; the winning path is then looked up in every page of the host and
its text extracted; a page without such a container uses its own best.  Votes are added up in the map task before they
are shuffled, so a host with a third of all pages is a few rows.

Winners (a host and a digest of its path) are broadcast while they have at most BROADCAST_BYTES, otherwise joined by host.

Names and forms are only a hint: they leave text out, inline too, unless the element is an article, main or body, holds
most of the page's text with no article outside, or is a form of running text.  Time is linear in a page's size, however
deep or broken it is: containers are numbered, and sums go up from child to parent once.

Edge cases: null and empty html give an empty text; a null url or one without host counts as host ''; unclosed and stray
tags are taken as browsers do, near enough; a page of plain text gives that text; unknown references stay as they are;
of equal containers the first is the page's best; equal rows each come back; other columns of pages are not looked at.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from functools import lru_cache
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, stored

BROADCAST_BYTES = 16 << 20
SHARE = 0.7  # of the page's running text that the best container must hold

# Fixed lists: elements by their role in HTML.
_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("html body main article section div td th table tbody tr aside nav header footer form ul ol dl center blockquote figure details fieldset menu dialog".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address caption figcaption summary br hr thead tfoot legend option".split())
_CHROME = frozenset("nav footer aside menu dialog button head".split())
_NEVER = frozenset("html body article main".split())
_CONTROLS = frozenset("input select textarea button".split())
CONTROL_TEXT = 200  # letters of running text for each control that make a form more than a form
_SIBLINGS = frozenset("li td tr dt dd".split())
_P_ENDS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre address hr".split())
_WORD = (
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|crumbs?|footer|foot|masthead|sidebar\w*|side|widget\w*|comments?|commentlist|"
    r"replies|respond|disqus|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|toolbar|pagination|pager|skip|copyright|legal|disclaimer|tags?|search\w*)"
)
_PLAIN = r"(?:container|wrapper|wrap|box|bar|list|links?|area|block|inner|outer|section|form|left|right|top|bottom|site|page|global|main|primary|secondary|\d+)"
# A class, id or role names chrome as a whole: words of chrome, with plain ones or after the article's; not tag-x or has-sidebar.
_WORDS = re.compile(rf"(?:^|\s)(?!tag[_-])(?:(?:(?:entry|post|article|{_PLAIN})[_-]+)*{_WORD}(?:[_-]+(?:{_WORD}|{_PLAIN}))*|(?:{_PLAIN}[_-]+)*header(?:[_-]+{_PLAIN})*)(?=$|\s)", re.I)
# As browsers read tags: quotes count behind an equals sign only; what is not closed runs to the end. No part can backtrack.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?:[^a-zA-Z>][^>]*+)?+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=/]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s]++))""")
_NAMED = re.compile(r"class|id|role", re.I)
_HIDDEN = re.compile(r"type\s*=\s*[\"']?hidden", re.I)
_DIGITS = re.compile(r"\d+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in _RAW}
_TO_END = frozenset("script style textarea title iframe".split())  # without an end tag these hold the rest of the page


class Page:
    """What parse() finds. Containers and doubtful elements are numbered as they open, 0 is the page; parents come first.

    blocks: (container, pieces) of each block of running text; a piece is (doubtful element, text, letters in links).
    """

    def __init__(self):
        self.parent, self.step, self.article = [0], [""], [False]
        self.mark_parent, self.form, self.controls = [0], [False], [0]
        self.blocks: list[tuple[int, list[tuple[int, str, int]]]] = []


def _names(attributes: str) -> str:
    """Values of class, id and role."""
    if not _NAMED.search(attributes):
        return ""
    return " ".join(b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes) if a.lower() in ("class", "id", "role"))


def parse(page: str | None) -> Page:
    """Containers and blocks of running text; what is chrome by its tag is left out, what may be by its name is marked."""
    out = Page()
    page = page or ""
    tags, chromes, containers, marks = [""], [False], [0], [0]  # the open elements, outermost first
    opened: dict[str, list[int]] = {}  # places of the open elements of each tag
    scopes = [0]  # places of the open containers
    pieces: list[tuple[int, str, int]] = []
    endless: set[str] = set()
    in_link = False
    at, size, search = 0, len(page), _TOKEN.search

    def flush():
        nonlocal pieces
        if pieces:
            out.blocks.append((containers[-1], pieces))
            pieces = []

    def close(k):
        for i in range(len(tags) - 1, k - 1, -1):
            opened[tags[i]].pop()
        while scopes[-1] >= k:
            scopes.pop()
        del tags[k:], chromes[k:], containers[k:], marks[k:]

    while at < size:
        m = search(page, at)
        start = m.start() if m else size
        if start > at and not chromes[-1]:
            pieces.append((marks[-1], page[at:start], start - at if in_link else 0))
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "a":
            in_link = not m[1]
        if m[1]:
            if tag in _BLOCKS:
                flush()
            own = opened.get(tag)
            if own and (tag in _BLOCKS or scopes[-1] <= own[-1]):
                close(own[-1])
            continue
        if tag in _CONTROLS and not _HIDDEN.search(m[3]):
            out.controls[marks[-1]] += 1
        if tag in _RAW:
            end = None if tag in endless else _RAW_END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in _TO_END:
                break
            else:
                endless.add(tag)
            continue
        if tag in _BLOCKS:
            flush()
            if tag in _P_ENDS and opened.get("p") and scopes[-1] <= opened["p"][-1]:
                close(opened["p"][-1])
            if tag in _SIBLINGS and tags[-1] == tag:
                close(len(tags) - 1)
        if tag in _VOID:
            if tag == "br":
                pieces.append((0, " ", 0))
            continue
        container, mark, chrome = containers[-1], marks[-1], chromes[-1] or tag in _CHROME
        names = _names(m[3]) if m[3] else ""
        if tag == "form" or names and tag not in _NEVER and _WORDS.search(names):
            out.mark_parent.append(mark)
            out.form.append(tag == "form")
            out.controls.append(0)
            mark = len(out.form) - 1
        opened.setdefault(tag, []).append(len(tags))
        if tag in _CONTAINERS:
            chrome = chrome or tag == "header" and not out.article[container]
            scopes.append(len(tags))
            out.parent.append(container)
            out.step.append(tag + "".join(f".{x}" for x in sorted(set(_DIGITS.sub("#", names.lower()).split()))))
            out.article.append(out.article[container] or tag == "article")
            container = len(out.parent) - 1
        tags.append(tag)
        chromes.append(chrome)
        containers.append(container)
        marks.append(mark)
    flush()
    return out


def _up(values: list, parents: list[int]) -> list:
    """Adds each number to those of all that it lies in."""
    for k in range(len(parents) - 1, 0, -1):
        values[parents[k]] += values[k]
    return values


def lines(page: Page) -> list[tuple[int, str, float]]:
    """(container, text, weight) of the blocks without those in doubtful elements (by name, or forms), but for elements that hold the page's text.

    Such are forms of running text, and elements with most of it while no article or main stands outside of them.
    """
    weight, total, article = [0.0] * len(page.form), 0.0, False
    named = [page.step[0] != ""]
    for p, s in zip(page.parent[1:], page.step[1:], strict=True):
        named.append(named[p] or s.split(".", 1)[0] in ("article", "main"))
    if len(page.form) > 1:
        for container, pieces in page.blocks:
            for mark, text, linked in pieces:
                w = max(0, len(" ".join(text.split())) - 2 * linked)
                total += w
                weight[mark] += w
                article |= not mark and w > 0 and named[container]
    weight, controls, fine = _up(weight, page.mark_parent), _up(list(page.controls), page.mark_parent), [True]
    for k in range(1, len(page.form)):
        holds = weight[k] > total / 2 and not article or page.form[k] and weight[k] >= CONTROL_TEXT * (controls[k] + 1)
        fine.append(fine[page.mark_parent[k]] and holds)
    out = []
    for container, pieces in page.blocks:
        text = "".join(x for mark, x, _ in pieces if fine[mark])
        line = " ".join((html_lib.unescape(text) if "&" in text else text).split())
        if line:
            out.append((container, line, max(0.0, len(line) - 2.0 * sum(n for mark, _, n in pieces if fine[mark]))))
    return out


def best(page: Page, found: list) -> tuple[int, float]:
    """Number and score of a page's best container: an article or main with much of the running text, else the deepest container with most of it."""
    n = len(page.parent)
    weight, present, depth = [0.0] * n, [0] * n, [0] * n
    for container, _, w in found:
        weight[container] += w
        present[container] = 1
    weight, present = _up(weight, page.parent), _up(present, page.parent)
    total = weight[0]
    named, deep = (0.0, 0, 0), (0, 0.0, 0)
    for c in range(1, n):
        depth[c] = depth[page.parent[c]] + 1
        if not present[c]:
            continue
        w = weight[c]
        if w >= 0.4 * total and page.step[c].split(".", 1)[0] in ("article", "main") and (not named[2] or (w, depth[c]) > named[:2]):
            named = (w, depth[c], c)
        if w >= SHARE * total and (not deep[2] or (depth[c], w) > deep[:2]):
            deep = (depth[c], w, c)
    return (named[2], log1p(named[0])) if named[2] else (deep[2], log1p(deep[1]))


def digests(page: Page) -> list[str]:
    """A digest of each container's generalised path: its step and its parent's digest."""
    out = [""]
    for p, s in zip(page.parent[1:], page.step[1:], strict=True):
        out.append(_digest(out[p], s))
    return out


@lru_cache(1 << 16)
def _digest(parent: str, step: str) -> str:
    return hashlib.blake2b(f"{parent}>{step}".encode(errors="replace"), digest_size=16).hexdigest()


def vote_of(html: str | None) -> tuple[str, int]:
    """Digest of the path that the page votes for ('' if none) and the vote's weight."""
    page = parse(html)
    number, score = best(page, lines(page))
    path = []
    while number:
        path.append(page.step[number])
        number = page.parent[number]
    digest = ""
    for step in reversed(path):
        digest = _digest(digest, step)
    return digest, round(score * 1000)


def text_of(html: str | None, winner: str | None = None) -> str:
    """The blocks in the containers of the winning path, or else in the page's best."""
    page = parse(html)
    found = lines(page)
    for chosen in (winner, None):
        if chosen:
            inside = [d == chosen for d in digests(page)]
        else:
            number = best(page, found)[0]
            inside = [k == number for k in range(len(page.parent))]
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[page.parent[k]]
        text = [line for c, line, _ in found if inside[c]]
        if text or not chosen:
            return " ".join(text)
    return ""


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def winners(pages: DataFrame) -> DataFrame:
    """host, path: the digest of the path with most votes of each host (ties: the smaller digest)."""

    def cast(batches):
        votes: dict = {}
        for b in batches:
            for h, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                path, weight = vote_of(html)
                if path:
                    votes[h, path] = votes.get((h, path), 0) + weight
            if len(votes) > 20_000:
                yield rows(votes)
                votes = {}
        yield rows(votes)

    def rows(votes):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"])

    each = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(cast, "host string, path string, votes long")
    return each.groupBy("host", "path").agg(F.sum("votes").alias("votes")).groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path"))["path"].alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html, ...)."""
    pages = pages.select("page_id", "url", "html")
    chosen = stored(winners(pages), "host-paths")
    held = chosen.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    chosen = F.broadcast(chosen) if held <= BROADCAST_BYTES else chosen
    named = pages.withColumn("host", host(F.col("url"))).join(chosen, "host", "left")

    def run(batches):
        for b in batches:
            out = [text_of(html, path) for html, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return named.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
