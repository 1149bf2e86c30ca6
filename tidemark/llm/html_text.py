"""Main text of web pages by consensus host paths.

First pass: each page's blocks are gathered by container (every open element), and containers are scored: prose, that
is text which is neither linked nor boilerplate, against links, with names that speak for or against the article
raising or lowering the score. A page votes for the best container's path: its chain of tag names and classes, with
digits generalised. Spark sums the votes by host. Second pass: the host's winning paths are sent along with its pages,
and each page's text is taken from the elements at the first of these paths that the page has and that holds a fair
share of its prose, or from its own best container if there is none.

What is boilerplate counts from the container down: a marked element (a menu, a comment list, a form) is left out of
the containers around it, but what the host's pages agree on, or a page's prose lies in, is the article even if a word
of its class says otherwise.

A page is parsed in one pass, in time linear in its length; elements deeper than DEPTH become siblings, as in
browsers. Votes are sums by (host, path). The winning paths go to every task while they are of few hosts, so that
pages aren't shuffled at all; beyond, pages are joined by host and piece, so that a host of any number of pages stays
spread.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Paths kept for each host, in order of votes; a page without any of them goes by its own.
HOST_PATHS = 4
#: A path needs this share of its host's votes; pages that differ have their own say.
LEAST_SHARE = 0.02
#: A winning path is used on a page if its score there is at least this share of the page's best.
LEAST_SCORE = 0.3
#: Hosts (a few hundred bytes each) up to which winning paths are sent to every executor, and pieces of a host beyond.
BROADCAST_HOSTS = 50_000
PIECES = 64
#: Elements open at once.
DEPTH = 512

#: Fixed values of HTML: elements without content, raw text, block-level and never-shown elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
HIDDEN = frozenset("head script style noscript template svg math canvas object audio video map iframe select option optgroup datalist button input textarea title xmp noembed noframes label".split())
#: Elements that are never the article, and those that may be all the same (a form around the whole page).
NOT_CONTENT = frozenset("nav footer aside menu dialog".split())
#: A start tag here ends an open p; li, dt/dd, tr, td/th and option end their own kind.
ENDS_P = BLOCKS - {"br", "html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table html body div article section main td th select menu dir".split())
#: Elements too small to be a container.
SMALL = frozenset("p a b i em strong span li h1 h2 h3 h4 h5 h6 td th tr tbody blockquote pre dt dd font".split())
#: Elements whose ids come from their text or their page.
NAMED_BY_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p a b i em strong span dt html body".split())
#: Roles that are never the article.
NOT_ROLE = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())
#: Words of classes and ids: of what isn't the article, of reader comments, of the article, and of neither.
NOT_ARTICLE = re.compile(
    r"ads?|advert\w*|adbox|adslot|banners?|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebars?|side|aside|widgets?|header|masthead|topbar|footer|foot|bottom|copyright|legal"
    r"|cookies?|consent|gdpr|notices?|alerts?|disclaimer|newsletter|subscribe|signup|login|popup|modal|overlay|shar(?:e\w*|ing)|social\w*|related|recommend\w*|trending|tags|taglist|pagination|pager|skip|toolbar|search|forms?|hidden"
)
COMMENTS = re.compile(r"comment\w*|respond|reply|replies|discussion|disqus|reactions")
ARTICLE = frozenset("article content post entry story body text main prose".split())
NEUTRAL = frozenset("site page global top left right wrap wrapper container list area section box block bar inner outer col column row the id thread links link nav items item s".split())
#: How certain it is that an element isn't the article: not at all, by a word among others, by words that all say so or name
#: the article ("post-comments") or as a form, by its tag or whole name, never shown. Within a container, what is LIKELY goes.
CLEAR, SUSPECT, LIKELY, MARKED, UNSEEN = range(5)
#: Words beside which a word of the lists above keeps its meaning.
OF_ARTICLE = ARTICLE | frozenset("posts articles entries stories contents blog".split())

#: Name and value of each attribute, in turn, so that nothing within a value counts as a name.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Without one of these there is nothing to read.
TOLD = re.compile("class|id|role|hidden|style", re.I)
#: Attributes up to this length are remembered.
REMEMBERED = 256
TAG_NAME = re.compile(r"[^\s/>]*")
COMMENT_END = re.compile(r"--!?>")
SPACE = re.compile(r"\s+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
PART = re.compile(r"[^\W\d_]+")


def _named(value: str) -> tuple[int, bool, bool]:
    """How certain a class or id is not the article's, whether a word is the article's, and whether it is a mere header's."""
    level, article, header = CLEAR, False, False
    for token in value.split():
        parts = [p.lower() for p in PART.findall(HUMP.sub("-", token))]
        bad = [p for p in parts if NOT_ARTICLE.fullmatch(p) or COMMENTS.fullmatch(p)]
        article = article or any(p in ARTICLE for p in parts)
        if bad == ["header"]:
            header = True
        elif bad:
            others = [p for p in parts if not (p in bad or p in NEUTRAL or len(p) == 1)]
            level = max(level, SUSPECT if any(p not in OF_ARTICLE for p in others) else LIKELY if others else MARKED)
    return level, article, header


def describe(tag: str, attributes: str) -> tuple[str, int, bool, bool]:
    """Of a start tag: the generalised step of a path, its level, whether it bears an article's name, whether it is a header."""
    if not TOLD.search(attributes):
        attributes = ""
    return (_remembered if len(tag) + len(attributes) <= REMEMBERED else _describe)(tag, attributes)


def _describe(tag: str, attributes: str) -> tuple[str, int, bool, bool]:
    classes, level, article, header = "", CLEAR, tag in ("article", "main"), tag == "header"
    if tag in HIDDEN:
        level = UNSEEN
    elif tag in NOT_CONTENT:
        level = MARKED
    elif tag == "form":
        level = LIKELY
    if attributes.strip():
        worst = CLEAR
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "class":
                classes = ".".join(sorted({re.sub(r"\d+", "0", c) for c in value.lower().replace("/", "|").split()}))
            if key == "class" and tag not in ("html", "body") or key == "id" and tag not in NAMED_BY_TEXT:
                found, own, head = _named(value)
                worst, article, header = max(worst, found), article or own, header or head
            elif key == "role":
                level = max(level, MARKED if value.lower() in NOT_ROLE else CLEAR)
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                level = UNSEEN
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                level = UNSEEN
        level = max(level, min(worst, LIKELY) if article else worst)
    return f"{tag}.{classes}" if classes else tag, level, article, header


_remembered = lru_cache(maxsize=1 << 14)(_describe)


@dataclass
class Page:
    """Elements in document order (0 is the root), and blocks of text in page order: element, text, linked characters.

    A path is a number; paths has it for each parent path and step.
    """

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    level: list[int] = field(default_factory=lambda: [CLEAR])
    article: list[bool] = field(default_factory=lambda: [False])
    depth: list[int] = field(default_factory=lambda: [0])
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def name(self, element: int) -> str:
        """The path of an element as text."""
        steps, named = [], {v: k for k, v in self.paths.items()}
        at = self.path[element]
        while at:
            at, step = named[at]
            steps.append(step)
        return "".join(f"/{s}" for s in reversed(steps))

    def find(self, name: str) -> int | None:
        at: int | None = 0
        for step in name.split("/")[1:]:
            at = self.paths.get((at, step))
            if at is None:
                break
        return at


class _Tags:
    """Where tags end, in time linear in the whole source."""

    def __init__(self, source: str):
        self.source, self.next, self.quotes = source, -1, True
        self.last = {q: source.rfind(q) for q in "\"'"}

    def first(self, at: int) -> int:
        """The first > from at on, or -1."""
        if self.next is not None and self.next < at:
            found = self.source.find(">", at)
            self.next = found if found >= 0 else None
        return -1 if self.next is None else self.next

    def end(self, at: int) -> int:
        """The > that ends the tag whose name is before at: the first outside quotes, or the first if quotes don't close."""
        close = self.first(at)
        if close < 0 or not self.quotes:
            return close
        here = at
        while True:
            marks = [m for m in (self.source.find(q, here, close) for q in "\"'") if m >= 0]
            if not marks:
                return close
            mark = min(marks)
            quote = self.source[mark]
            if mark >= self.last[quote]:  # opens and never closes: from here on no quote counts
                self.quotes = False
                return self.first(at)
            here = self.source.find(quote, mark + 1) + 1
            if here > close:
                close = self.source.find(">", here)
                if close < 0:
                    self.quotes = False
                    return self.first(at)


def parse(source: str) -> Page:
    """Elements and text blocks of a page; broken nesting is closed as it comes.

    A tag that never ends is text. A comment or raw element that never ends hides what follows.
    """
    page, tags = Page(), _Tags(source)
    stack = [0]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = 0
    unseen = 0  # the length of the stack at which what isn't shown began

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                owner = next((e for e in reversed(stack) if page.tag[e] in BLOCKS), 0)
                page.blocks.append((owner, text, min(linked, len(text))))
        linked = 0

    def close(to: int) -> None:
        nonlocal unseen
        if any(page.tag[e] in BLOCKS for e in stack[to:]):
            flush()
        for e in stack[to:]:
            opened[page.tag[e]] -= 1
        del stack[to:]
        if unseen and len(stack) < unseen:
            unseen = 0

    at, size = 0, len(source)
    while at < size:
        start = source.find("<", at)
        text_end = start if start >= 0 else size
        after, name = text_end, ""
        if start >= 0:
            slash = source.startswith("/", start + 1)
            first = source[start + 1 + slash : start + 2 + slash]
            if first.isascii() and first.isalpha() and tags.first(start) >= 0:
                name = TAG_NAME.match(source, start + 1 + slash)[0]
                after = tags.end(start + 1 + slash + len(name)) + 1
            elif source.startswith("<!--", start):
                found = COMMENT_END.search(source, start + 2)
                after = found.end() if found else size
            elif first and (slash or first in "!?"):
                ends = tags.first(start)
                after = ends + 1 if ends >= 0 else size
            else:
                after = start + 1
            if after == start + 1:  # not a tag
                name, text_end = "", after
        if text_end > at and not unseen:
            pieces.append(source[at:text_end])
            if opened["a"] > 0:
                linked += len(source[at:text_end].strip())
        at = after
        if not name:
            continue
        tag = name.lower()
        if slash:
            if tag == "br" or tag == "p" and opened["p"] <= 0:
                flush()
            elif opened[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    here = page.tag[stack[k]]
                    if here == tag:
                        close(k)
                        break
                    if tag not in BLOCKS and here in BLOCKS:
                        break  # an inline end tag doesn't close a block
            continue
        if tag in ENDS_P and opened["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                here = page.tag[stack[k]]
                if here == "p":
                    close(k)
                    break
                if here in SCOPES:
                    break
        if tag in SIBLINGS and any(opened[t] > 0 for t in SIBLINGS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                here = page.tag[stack[k]]
                if here in SIBLINGS[tag]:
                    close(k)
                    if tag != "tr":
                        break
                elif here in SCOPES:
                    break
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        attributes = source[start + 1 + len(name) : at - 1]
        if tag in ("svg", "path") and attributes.rstrip().endswith("/"):
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            if found is None:
                break
            at = found.end()
            continue
        step, level, article, header = describe(tag, attributes)
        if len(stack) >= DEPTH:
            close(DEPTH - 1)
        parent = stack[-1]
        if header and level < MARKED and not article and not page.article[parent]:
            level = MARKED
        if tag not in BLOCKS and level in (LIKELY, MARKED):
            level = UNSEEN  # within a line there is no container
        page.tag.append(tag)
        page.parent.append(parent)
        page.path.append(page.paths.setdefault((page.path[parent], step), len(page.paths) + 1))
        page.level.append(level)
        page.article.append(page.article[parent] or article)
        page.depth.append(page.depth[parent] + 1)
        stack.append(len(page.tag) - 1)
        opened[tag] += 1
        if level == UNSEEN and not unseen:
            unseen = len(stack)
    flush()
    return page


#: What an element's own name and those around it leave of its score, by level.
FACTOR = (1.0, 0.5, 0.5, 0.0, 0.0)


def scores(page: Page) -> list[float]:
    """How much each element looks like the one that holds the article."""
    n = len(page.tag)
    chars, links = [0] * n, [0] * n
    total = 0
    for owner, text, linked in page.blocks:
        chars[owner] += len(text)
        links[owner] += linked
        total += len(text) - linked
    for e in range(n - 1, 0, -1):
        if not page.level[e] or page.level[e] == SUSPECT and page.article[page.parent[e]]:
            chars[page.parent[e]] += chars[e]
            links[page.parent[e]] += links[e]
    factor, out = [1.0] * n, [0.0] * n
    for e in range(1, n):
        factor[e] = min(factor[page.parent[e]], FACTOR[page.level[e]])
        if chars[e] and factor[e] and page.tag[e] not in SMALL:
            prose = chars[e] - links[e]
            value = prose / max(total, 1) * (prose / chars[e])
            if page.article[e] and not page.article[page.parent[e]] or page.tag[e] in ("article", "main"):
                value *= 1.5
            elif page.article[e]:
                value *= 1.4
            out[e] = factor[e] * (value + 0.001 * min(page.depth[e], 50) * (value > 0))
    return out


def best(page: Page) -> str:
    """The path of the element with the highest score, the first of equal ones; empty if there is none."""
    found = scores(page)
    top = max(range(len(found)), key=found.__getitem__)
    return page.name(top) if found[top] > 0 else ""


def _inside(page: Page, path: int | None) -> str:
    """Text of the blocks in elements at a path (None: in the page), without what is likely not the article within them."""
    inside = [path is None] + [False] * (len(page.tag) - 1)
    for e in range(1, len(page.tag)):
        inside[e] = path is not None and page.path[e] == path or inside[page.parent[e]] and page.level[e] < LIKELY
    return "\n".join(text for owner, text, _ in page.blocks if inside[owner])


def text_at(page: Page, paths: list[str]) -> str:
    """Text of the elements at the first path that scores well; else at the page's own best path; else of all clear blocks."""
    found = scores(page)
    top = max(range(len(found)), key=found.__getitem__)
    if found[top] <= 0:
        return _inside(page, None)
    for name in paths:
        path = page.find(name)
        if path is not None and max((s for s, p in zip(found, page.path) if p == path), default=0) >= LEAST_SCORE * found[top]:
            return _inside(page, path)
    return _inside(page, page.path[top])


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return found[1].lower() if found else ""


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], int] = {}
        for url, source in zip(batch.column("url"), batch.column("html")):
            path = best(parse(source.as_py() or ""))
            if path:
                key = host_of(url.as_py()), path
                votes[key] = votes.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(votes.values(), pa.int64())], ["host", "path", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text_at(parse(source.as_py() or ""), paths.as_py() or []) for source, paths in zip(batch.column("html"), batch.column("paths"))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def winning_paths(pages: DataFrame, most: int = HOST_PATHS, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, paths: the paths that a host's pages voted for, most votes first, as far as they have least_share of them."""
    cast = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    votes = cast.mapInArrow(_vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    ranked = votes.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path")))
    ranked = ranked.withColumn("share", F.col("votes") / F.sum("votes").over(Window.partitionBy("host")))
    top = ranked.filter((F.col("rank") <= most) & (F.col("share") >= least_share))
    return top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("ranked")).select("host", F.col("ranked.path").alias("paths"))


def extract(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html; more columns are left out).

    Null or empty html gives an empty text. Rows whose url is null or names no host share one empty host. Repeated rows
    each get a row.
    n_chars counts code points.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    paths = Scratch(pages.sparkSession, "host-paths").keep(winning_paths(pages))
    if paths.count() <= broadcast_hosts:
        known = rows.join(F.broadcast(paths), "host", "left")
    else:
        pieces = paths.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
        known = rows.withColumn("piece", F.pmod(F.xxhash64("page_id", "url"), F.lit(PIECES)).cast("int")).join(pieces, ["host", "piece"], "left")
    known = known.select("page_id", "url", "html", "paths")
    texts = known.mapInArrow(_extract, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
