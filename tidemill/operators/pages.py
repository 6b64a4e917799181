"""Web pages: title, language, main text and links of raw HTML.

A page is read as a stream of tags and texts (the standard library's tokenizer, which takes broken markup as it comes), in
Arrow batches. Text between block tags is a block; scripts, styles, templates and comments are none. A block
is boilerplate if it stands in a navigation, header, footer, aside or form, or if more than LINKED of its words are link texts.
Of the rest, blocks of at least LONG words are main text; shorter ones are if they are paragraphs or items next to main text
(the nearest block before or after, short ones aside) or headings before it. So a page is cut by how dense its text is and not by names of its classes.

Links are the a and area elements with href outside of scripts, templates and the like. Targets are resolved against the page's base element or url; only those of http and
https have one. Scheme and host are lower-cased, the fragment and the port that goes without saying are dropped, and an empty path is /.

Null pages are empty: no title, no blocks, no links. Null or broken urls leave relative targets null. Very long pages are taken whole. Repeated rows give repeated
results, an empty table none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that make a block main text by itself, and the share of link words from which on it is boilerplate.
LONG, LINKED = 10, 1 / 3
#: Pages whose rows are given out at a time.
AT_ONCE = 256
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
HIDDEN = {"script", "style", "noscript", "template", "iframe", "svg", "select", "textarea"}
FRAME = {"nav", "header", "footer", "aside", "form", "menu"}
#: Short blocks that may be main text by their neighbours.
PROSE = {"p", "blockquote", "pre", "li", "dt", "dd"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def target_of(base: str | None, href: str | None) -> str | None:
    try:
        parts = urlsplit(urljoin(base or "", (href or "").strip()))
        if parts.scheme.lower() not in ("http", "https") or not parts.hostname:
            return None
        port = f":{parts.port}" if parts.port and parts.port != {"http": 80, "https": 443}[parts.scheme.lower()] else ""
        host = f"[{parts.hostname}]" if ":" in parts.hostname else parts.hostname
        return f"{parts.scheme.lower()}://{host}{port}{parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        return None


class Page(HTMLParser):
    """Reads one page. blocks: [kind, in frame, words, link words, text]; links: [href, text, nofollow]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.lang: str | None = None
        self.base: str | None = None
        self.blocks: list[tuple[str, bool, int, int, str]] = []
        self.links: list[tuple[str, str, bool]] = []
        self._text: list[tuple[str, bool]] = []  # pieces of the open block, and whether each is a link's
        self._kind, self._hidden, self._frame, self._title = "body", [], [], None
        self._link: tuple[str | None, list[str], bool] | None = None

    def _end_block(self) -> None:
        said = " ".join("".join(t for t, _ in self._text).split())
        if said:
            linked = sum(len(t.split()) for t, link in self._text if link)
            self.blocks.append((self._kind, bool(self._frame), len(said.split()), linked, said))
        self._text = []

    def _end_link(self) -> None:
        if self._link and self._link[0] is not None:
            self.links.append((self._link[0], " ".join("".join(self._link[1]).split()), self._link[2]))
        self._link = None

    def handle_starttag(self, tag, attrs):
        has = dict(reversed(attrs))  # of an attribute that is given twice the first counts
        if tag in HIDDEN:
            self._hidden.append(tag)
        elif tag == "html":
            self.lang = self.lang or has.get("lang")
        elif tag == "base" and self.base is None:
            self.base = has.get("href")
        elif self._hidden:
            return
        elif tag == "area":
            self._end_link()
            self._link = (has.get("href"), [has.get("alt") or ""], "nofollow" in (has.get("rel") or "").lower().split())
            self._end_link()
        elif tag == "a":
            self._end_link()
            self._link = (has.get("href"), [], "nofollow" in (has.get("rel") or "").lower().split())
        if tag in BLOCKS:
            self._end_block()
            self._kind = tag if tag not in ("br", "hr") else self._kind
        if tag in FRAME:
            self._frame.append(tag)
        if tag == "title" and self.title is None and not self._hidden:
            self._title = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN or tag in FRAME or tag == "a":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._hidden:
            if tag == self._hidden[-1]:
                self._hidden.pop()
            return
        if tag == "a":
            self._end_link()
        elif tag == "title" and self._title is not None:
            self.title, self._title = " ".join("".join(self._title).split()), None
        if tag in BLOCKS:
            self._end_block()
            self._kind = "body"
        if tag in self._frame:
            del self._frame[len(self._frame) - 1 - self._frame[::-1].index(tag) :]

    def handle_data(self, data):
        if self._title is not None:
            self._title.append(data)
        elif not self._hidden:
            self._text.append((data, self._link is not None))
            if self._link:
                self._link[1].append(data)

    def finish(self) -> None:
        self.close()
        self._end_link()
        self._end_block()
        if self._title is not None:
            self.title = " ".join("".join(self._title).split())


def read_page(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.finish()
    return page


def main_blocks(blocks: list[tuple[str, bool, int, int, str]]) -> list[str]:
    """The texts of the blocks that are main text."""
    state = []  # True: main text, False: boilerplate, None: as its neighbours
    for kind, frame, n, linked, _ in blocks:
        state.append(False if frame or linked > LINKED * n else True if n >= LONG else None)
    ahead, near, out = [False] * len(state), False, []
    for i in range(len(state) - 1, -1, -1):
        near = near if state[i] is None else state[i]
        ahead[i] = near
    behind = False
    for i, (kind, _, _, _, text) in enumerate(blocks):
        behind = behind if state[i] is None else state[i]
        if state[i] or state[i] is None and (kind in HEADINGS and ahead[i] or kind in PROSE and (ahead[i] or behind)):
            out.append(text)
    return out


def _in_batches(pages: DataFrame, rows_of, schema: str) -> DataFrame:
    """The rows that rows_of(page_id, url, html) gives, as a table."""
    kinds = pages.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(kinds)
        for b in batches:
            for i in range(0, len(b), AT_ONCE):
                part = b.slice(i, AT_ONCE)
                rows = [r for own in zip(*(part.column(c) for c in ("page_id", "url", "html"))) for r in rows_of(*(x.as_py() for x in own))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, kinds)


def texts(pages: DataFrame) -> DataFrame:
    """page_id, url, lang, title, text (main blocks, one a line), n_blocks, n_main, n_words (of the text) of each page."""

    def rows_of(page_id, url, html):
        page = read_page(html)
        kept = main_blocks(page.blocks)
        yield page_id, url, page.lang, page.title, "\n".join(kept), len(page.blocks), len(kept), sum(len(t.split()) for t in kept)

    return _in_batches(pages, rows_of, "page_id long, url string, lang string, title string, text string, n_blocks long, n_main long, n_words long")


def links(pages: DataFrame) -> DataFrame:
    """page_id, at (from 0), href, target, anchor, nofollow: a row for each link."""

    def rows_of(page_id, url, html):
        page = read_page(html)
        base = target_of(url, page.base) or url if page.base else url
        for at, (href, anchor, nofollow) in enumerate(page.links):
            yield page_id, at, href, target_of(base, href), anchor, nofollow

    return _in_batches(pages, rows_of, "page_id long, at long, href string, target string, anchor string, nofollow boolean")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def link_counts(pages: DataFrame) -> DataFrame:
    """page_id, n_links, n_targets (different ones), n_internal (to the page's own host) of each page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("own")).distinct()
    found = links(pages).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))
    found = found.join(own, "page_id")
    inner = F.when(host(F.col("target")) == F.col("own"), F.col("n")).otherwise(0)
    found = found.groupBy("page_id").agg(F.sum("n").alias("n_links"), F.count("target").alias("n_targets"), F.sum(inner).alias("n_internal"))
    none = F.lit(0).cast("long")
    return own.select("page_id").distinct().join(found, "page_id", "left").select("page_id", *[F.coalesce(c, none).alias(c) for c in ("n_links", "n_targets", "n_internal")])


def host_graph(pages: DataFrame) -> DataFrame:
    """from_host, to_host, n_links, n_pages: how often pages of one host link to another, or to their own."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("from_host"))
    each = links(pages).where("target is not null").groupBy("page_id", host(F.col("target")).alias("to_host")).agg(F.count(F.lit(1)).alias("n"))
    return each.join(own.distinct(), "page_id").groupBy("from_host", "to_host").agg(F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_pages"))
