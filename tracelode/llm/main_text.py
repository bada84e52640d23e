"""Main text of web pages by tag-path ratios (operator 12).

A page's text is cut into blocks, each at the end of a path of block elements from the root. By path, text and punctuation are summed and divided by the
number of blocks; both ratios are fused into one score, paths are smoothed with those that fill the container they lie in, and paths above a share
of the page's typical score are content. Elements that never hold an article (menus, headers, footers, forms, scripts, ...), or whose class, id or role says so,
are left out before; where a page marks its article, only what lies in it can be content.

A null or empty page, and one without content, has the empty text. Repeated pages give a row each; an empty table gives an empty one. A page is one row and one
string, read once from front to back, whatever its length or depth; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, ship, text_of

#: Share of the page's typical score from which a path is content by itself, and the share that smoothing gives to what lies in the same container.
THRESHOLD, SMOOTHING = 0.5, 0.6
#: Part of a path's text inside links from which lists and boxes count as menus.
LINKED = 0.8
#: A marked article of fewer characters, or of a smaller share of all candidate text, is no guide to the page.
ARTICLE_CHARS, ARTICLE_SHARE = 140, 0.25

# Fixed values of HTML, and words by which pages name what is no article.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark math nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
LEFT_OUT = frozenset("applet aside audio button canvas datalist dialog fieldset footer form head map menu nav noscript object optgroup option select svg template video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion guestbook replies reply respond responses".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
BOX_WORDS = COMMENT_WORDS | HEADER_WORDS | frozenset(
    "ad ads adsense adbox adslot advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr login "
    "menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended related share sharing sidebar signin signup social sponsor "
    "sponsored subscribe subscription toolbar trending widget".split()
)
_CLOSED_BY = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
_CLOSED_BY |= {t: ("thead tbody tfoot tr td th caption colgroup", ("table",)) for t in ("thead", "tbody", "tfoot")}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…،؛؟。、，；：！？]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


@dataclass
class Block:
    """A run of text between block elements. `boxes` are the numbers of the boxes around it that their names call no article."""

    text: str
    path: int
    linked: int
    boxes: tuple[int, ...]
    article: int
    heading: bool
    score: float = 0.0
    kept: bool = False


@dataclass
class _Open:
    tag: str
    path: int
    boxes: tuple[int, ...]
    article: int
    skipped: bool
    header: bool


@dataclass
class Page:
    """The blocks of a page, and its paths as a tree: the tag, name and parent of each."""

    blocks: list[Block] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: [""])
    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    about_comments: list[bool] = field(default_factory=list)
    has_article: list[bool] = field(default_factory=list)
    articles: int = 0

    def path_of(self, path: int) -> str:
        out = []
        while path > 0:
            out.append(self.names[path])
            path = self.parents[path]
        return "/".join(reversed(out))


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(raw))} if raw.strip("/ \t\n") else {}


def parse(source: str) -> Page:
    """Blocks in page order, without what elements and roles leave out. Tags are closed as browsers do where pages forget to."""
    page, known = Page(), {}
    stack = [_Open("", 0, (), 0, False, False)]
    parts: list[str] = []
    linked, in_link, breaks = 0, 0, 0

    def flush() -> None:
        nonlocal linked, breaks
        if parts:
            text = " ".join("".join(parts).split())
            top = stack[-1]
            if text:
                page.blocks.append(Block(text, top.path, min(linked, len(text)), top.boxes, top.article, any(page.tags[p] in HEADINGS for p in (top.path, page.parents[top.path]) if p > 0)))
            parts.clear()
        linked, breaks = 0, 0

    def add(piece: str) -> None:
        nonlocal linked, breaks
        if piece and not stack[-1].skipped and (not stack[-1].header or stack[-1].tag in HEADINGS):
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            solid = len(piece) if not piece.isspace() else 0
            breaks = 0 if solid else breaks
            linked += solid if in_link else 0

    def close(tags: tuple[str, ...] | str, within: tuple[str, ...] = ()) -> None:
        wanted = tags.split() if isinstance(tags, str) else tags
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in wanted:
                flush()
                del stack[i:]
                return
            if stack[i].tag in within:
                return

    def open_(tag: str, raw: str) -> None:
        if stack[-1].tag == "p":
            close("p")
        if tag in _CLOSED_BY:
            tags, within = _CLOSED_BY[tag]
            for _ in tags.split():
                close(tags, within)
        flush()
        if tag in VOID or tag in ("html", "body") and any(s.tag == tag for s in stack):
            return
        top, given = stack[-1], _attributes(raw)
        names = f"{given.get('class', '')} {given.get('id', '')} {given.get('itemprop', '')}"
        words = {w.lower() for w in _WORD.findall(names)} if names.strip() else set()
        role = given.get("role", "").lower()
        main = tag in ("article", "main") or role in ("main", "article") or "articleBody" in names
        skipped = top.skipped or tag in LEFT_OUT or role in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", "").lower()))
        skipped = skipped and tag not in ("html", "body")
        header = top.header or tag == "header" and top.article > 0
        skipped = skipped or tag == "header" and not top.article
        boxes, article = top.boxes, top.article
        called = words & (COMMENT_WORDS if main else BOX_WORDS - HEADER_WORDS if top.article or tag in HEADINGS else BOX_WORDS)
        if called and tag not in ("html", "body"):
            boxes = (*boxes, len(page.about_comments))
            page.about_comments.append(bool(called & COMMENT_WORDS))
            page.has_article.append(False)
        if main and not skipped:
            if tag == "article" and article and any(s.tag == "article" for s in stack):
                boxes = (*boxes, len(page.about_comments))  # an article inside another one is a comment on it
                page.about_comments.append(True)
                page.has_article.append(False)
            else:
                for b in boxes:
                    page.has_article[b] = page.has_article[b] or not page.about_comments[b]
                page.articles += 1
                article = article or page.articles
        name = ".".join([tag, *sorted(words)])
        path = known.get((top.path, name))
        if path is None:
            path = known[top.path, name] = len(page.tags)
            page.tags.append(tag)
            page.names.append(name)
            page.parents.append(top.path)
        stack.append(_Open(tag, path, boxes, article, skipped, header))

    at, n = 0, len(source)
    while at < n:
        left = source.find("<", at)
        if left < 0:
            add(source[at:])
            break
        add(source[at:left])
        if source.startswith("<!--", left):
            end = source.find("-->", left + 4)
            at = n if end < 0 else end + 3
            continue
        if source[left + 1 : left + 2] in ("!", "?"):
            end = source.find(">", left)
            at = n if end < 0 else end + 1
            continue
        found = _TAG.match(source, left) or _LOOSE.match(source, left)
        if found is None:
            after = source[left + 1 : left + 2]
            if after.isascii() and after.isalpha() or after == "/":
                break  # a tag that the page's end cuts
            add("<")
            at = left + 1
            continue
        at, tag, ends = found.end(), found[2].lower(), bool(found[1])
        if tag in RAW:
            if not ends:
                end = _RAW_END[tag].search(source, at)
                at = n if end is None else end.end()
        elif tag == "br":
            breaks += 1
            add(" ")
            if breaks > 1:
                flush()
        elif tag == "a":
            in_link = 0 if ends else 1
        elif tag in INLINE:
            pass
        elif ends:
            if tag not in ("html", "body"):
                close((tag,), () if tag in ("table", "tr", "td", "th", "thead", "tbody", "tfoot") or tag not in ("p", "li", "dt", "dd") else ("table", "td", "th", "article", "main", "section"))
                flush()
        else:
            open_(tag, found[3])
    flush()
    return page


def _left(page: Page) -> list[Block]:
    """Blocks in no box that its name calls no article. A name does not count where the box holds the marked article, or most of the text."""
    sizes = [0] * len(page.about_comments)
    for b in page.blocks:
        for box in b.boxes:
            sizes[box] += len(b.text)
    total = sum(len(b.text) for b in page.blocks)
    real = [not holds and (comments or size <= 0.6 * total) for holds, comments, size in zip(page.has_article, page.about_comments, sizes, strict=True)]
    left = [b for b in page.blocks if not any(real[x] for x in b.boxes)]
    marked = sum(len(b.text) for b in left if b.article)
    if marked >= ARTICLE_CHARS or marked > ARTICLE_SHARE * sum(len(b.text) for b in left):
        left = [b for b in left if b.article]
    return left


def choose(page: Page) -> None:
    """Sets score and kept of the page's blocks."""
    left = _left(page)
    sums: dict[int, list[int]] = {}
    for b in left:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for i, x in enumerate((1, len(b.text), len(_PUNCTUATION.findall(b.text)), b.linked)):
            s[i] += x
    # the two ratios of a path, fused by their geometric mean; text in links does not speak for a path
    own = {p: ((chars - links) / n * (1 + marks / n)) ** 0.5 for p, (n, chars, marks, links) in sums.items()}
    total = sum(s[1] for s in sums.values())
    limit = THRESHOLD * sum(own[p] * s[1] for p, s in sums.items()) / max(total, 1)
    # a container whose paths include one above the limit; a marked article is one by its mark
    filled = {page.parents[p] for p in sums if own[p] >= limit and own[p] > 0}
    marked = any(b.article for b in left)
    smoothed = {}
    for p, (_, chars, _, links) in sums.items():
        score, around, below = own[p], page.parents[p], page.tags[p]
        menu = links >= LINKED * chars and below not in ("p", "blockquote", "pre") and below not in HEADINGS
        near = marked
        while around >= 0 and not near:
            near = around in filled and (below != "div" or page.tags[around] not in ("", "body"))
            below, around = page.tags[around], page.parents[around]
        # smoothing lifts what lies beside or below a filling path to a share of the typical score
        smoothed[p] = 0.0 if menu else max(score, SMOOTHING / THRESHOLD * limit) if near else score
    for b in left:
        b.score = smoothed[b.path]
        b.kept = b.score >= limit and b.score > 0 or marked and b.heading and b.linked < len(b.text)


def main_text_of(source: str) -> str:
    page = parse(source)
    choose(page)
    return "\n".join(b.text for b in page.blocks if b.kept)


def blocks(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """page_id, block (its place in the page, from 0), path, text, score, kept of every block that elements and roles do not leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch, "html"):
                rows = []
                for page_id, source in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                    page = parse(source)
                    choose(page)
                    rows += [(page_id, i, page.path_of(x.path), x.text, x.score, x.kept) for i, x in enumerate(page.blocks)]
                names = ["page_id", "block", "path", "text", "score", "kept"]
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    ship(pages.sparkSession)
    return pages.select(F.col(key).cast("long").alias("page_id"), text_of(column).alias("html")).mapInArrow(run, "page_id long, block int, path string, text string, score double, kept boolean")


def main_text(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page: its main text, a line a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch, "html"):
                texts = [main_text_of(s) for s in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ship(pages.sparkSession)
    return pages.select(F.col(key).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of(column).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
