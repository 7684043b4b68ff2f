"""Main text of web pages: site templates are found by counting and removed.

Every page is read into elements. Subtrees that may be template (any element that neither is
nor holds the article, and inside the article only containers, not its paragraphs) are hashed;
the hashes are counted per host over pages of different content, so copies of a page count once. Those
on at least ``min_pages`` and ``min_share`` of such pages, or on ``enough`` of them however large the host, are
template, and are deleted with all they hold. Pages without url belong to no host; nothing is counted over them.

Tags of menus, footers, side bars, forms and scripts go on any host. So do elements whose class, id or role says
that they are such, adverts, notices or comments, as far as that can be: where a page has an article (or main) element outside all
of these, they go; else those that are or hold one stay, and on a page without any those that hold
more than half of its text. If a page has an article or main element, only text inside it is kept.

Blocks are joined by two line feeds; white space inside a block becomes one space; character references
are decoded. Null and empty pages have the empty text. Unclosed
tags are closed where their parent ends; a tag that never ends is text. Repeated rows give
repeated results.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .batches import prepare, slices, strings

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+>|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
GONE = RAW | {"nav", "footer", "aside", "form", "button", "select", "head", "menu", "dialog"}
MAIN = {"article", "main"}
BLOCK = MAIN | {"html", "body", "div", "p", "section", "header", "footer", "nav", "aside", "form", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
                "caption", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "address", "hr", "details", "summary", "fieldset", "menu", "dialog", "head"}
CONTAINER = {"div", "section", "header", "footer", "nav", "aside", "form", "menu", "dialog", "details"}
# a start tag closes these when they are open
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Words of class, id and role that mark what isn't the article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "banner", "cookie", "cookies", "consent", "notice", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
         "breadcrumbs", "comment", "comments", "disqus", "promo", "share", "sharing", "social", "related", "newsletter", "subscribe", "footer", "popup", "modal", "search", "login", "toolbar", "pager",
         "pagination", "contentinfo", "complementary", "skip"}
SPLIT = re.compile(r"[^a-z0-9]+")


class Page:
    """Blocks of one page, each with the template candidates it stands in."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = []  # text, candidates and article elements it stands in
        self.hashes: dict[int, int] = {}
        self.marked: dict[int, bool] = {}  # marked elements, and whether they are or hold an article
        self.mains: dict[int, bool] = {}  # article elements, and whether they stand outside all marked ones
        self._text: list[str] = []
        self._ids = 0
        self._read(source)

    def _flush(self, stack) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            self._text = []
            if text:
                self.blocks.append((text, tuple(n[4] for n in stack if n[4]), tuple(n[5] for n in stack if n[5])))

    def _close(self, stack, source: str, end: int) -> None:
        node = stack.pop()
        tag, start, _, holds, key, main, has_main = node
        if tag in BLOCK:
            # the text belongs to the element, which is off the stack now
            self._flush([*stack, node])
        if holds and stack:
            stack[-1][3] = True
        if has_main and stack:
            stack[-1][6] = True
        if key in self.marked:
            self.marked[key] = bool(has_main)
        if key and not holds:
            self.hashes[key] = xxhash.xxh64_intdigest(" ".join(source[start:end].split())) - (1 << 63)

    def _read(self, source: str) -> None:
        # tag, start, dropped, holds the article or its heading, candidate number, article number, is or holds an article
        stack: list[list] = []
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.match(source, at)
            start, at = at, m.end()
            tag = m[2]
            if tag is None:
                piece = m[0]
                if piece[0] != "<" or piece == "<":
                    if not (stack and stack[-1][2]):
                        self._text.append(piece)
                continue
            tag = tag.lower()
            if m[1]:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                if depth >= 0:
                    while len(stack) > depth:
                        self._close(stack, source, at if len(stack) == depth + 1 else start)
                continue
            if tag in BLOCK:
                self._shut(stack, source, start, "p", ())
                self._flush(stack)
            if tag in CLOSES:
                for other in CLOSES[tag]:
                    self._shut(stack, source, start, other, BOUNDS[tag])
            if tag in VOID or m[3].endswith("/") and tag not in RAW and tag not in BLOCK:
                if tag == "br":
                    self._text.append(" ")
                continue
            inside = any(n[0] in MAIN for n in stack)
            gone = bool(stack and stack[-1][2]) or tag in GONE or tag == "header" and not inside
            marked = False
            if not gone and m[3] and tag not in ("html", "body"):
                words = {w for a in ATTRIBUTE.finditer(m[3]) for w in SPLIT.split((a[2] or a[3] or a[4] or "").lower())}
                marked = bool(words & MARKS)
            if tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = stop.end() if stop else end
                continue
            key = article = 0
            if marked or not gone and tag not in ("html", "body") and (tag in CONTAINER or not inside and tag in BLOCK - MAIN):
                self._ids += 1
                key = self._ids
            if marked:
                self.marked[key] = False
            if tag in MAIN and not gone:
                self._ids += 1
                article = self._ids
                self.mains[article] = not marked and not any(n[4] in self.marked for n in stack)
            stack.append([tag, start, gone, bool(article) or tag == "h1" and not gone, key, article, bool(article)])
        while stack:
            self._close(stack, source, end)
        self._flush(stack)

    def _shut(self, stack, source: str, end: int, tag: str, bounds) -> None:
        """Close the innermost open ``tag``, if no bound stands between."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                while len(stack) > i:
                    self._close(stack, source, end)
                return
            if stack[i][0] in bounds or tag == "p" and stack[i][0] in BLOCK:
                return

    def _off(self) -> set[int]:
        """Marked elements that go."""
        if any(self.mains.values()):
            return set(self.marked)
        if self.mains:
            return {k for k, holds in self.marked.items() if not holds}
        size: dict[int, int] = {}
        for text, keys, _ in self.blocks:
            for k in keys:
                size[k] = size.get(k, 0) + len(text)
        half = sum(len(t) for t, _, _ in self.blocks) / 2
        return {k for k in self.marked if size.get(k, 0) <= half}

    def text(self, template: set[int]) -> str:
        off = self._off()
        dead = off | {k for k, h in self.hashes.items() if h in template}
        return "\n\n".join(t for t, keys, mains in self.blocks if (mains or not self.mains) and dead.isdisjoint(keys))

    def candidates(self) -> list[int]:
        """Hashes of the subtrees that may be template."""
        return sorted({h for k, h in self.hashes.items()})

    def content(self) -> int:
        """Hash of all text, the same for copies of a page."""
        return xxhash.xxh64_intdigest("\n".join(t for t, _, _ in self.blocks)) - (1 << 63)


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def extracted(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", source: str = "html", min_pages: int = 3, min_share: float = 0.3, enough: int = 50) -> DataFrame:
    """page_id, url and text of every page."""
    prepare(pages.sparkSession)
    narrow = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("html"))
    keyed = narrow.select("*", host("url").alias("host"), F.xxhash64("page_id", "url", "html").alias("key"))

    def hashed(batches):
        for batch in slices(batches, 2):
            pages_ = [Page(t) for t in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.content() for p in pages_], pa.int64()),
                                              pa.array([p.candidates() for p in pages_], pa.list_(pa.int64()))], ["host", "key", "content", "hashes"])

    subtrees = keyed.where("host <> ''").select("host", "key", "html").mapInArrow(hashed, "host string, key long, content long, hashes array<long>")
    each = subtrees.select("host", "key", F.explode("hashes").alias("hash"))
    # copies of a page are one
    different = subtrees.groupBy("host", "content").agg(F.min("hashes").alias("hashes"))
    sizes = different.groupBy("host").agg(F.least(F.greatest(F.lit(min_pages), F.ceil(F.count("*") * min_share)), F.lit(max(enough, min_pages))).alias("needed"))
    template = (different.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
                .join(sizes, "host").where(F.col("n") >= F.col("needed")).select("host", "hash"))
    # a page has few subtrees that recur, so the set of a page is small
    drops = each.join(template, ["host", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("template"))
    joined = keyed.join(drops, "key", "left").select("page_id", "url", "html", F.coalesce("template", F.array().cast("array<long>")).alias("template"))

    def cleaned(batches):
        for batch in slices(batches, 2):
            texts = [Page(t).text(set(drop)) for t, drop in zip(strings(batch.column(2)), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = narrow.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(cleaned, f"page_id {kind}, url {narrow.schema['url'].dataType.simpleString()}, text string")
