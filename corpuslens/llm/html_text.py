"""Main text of web pages: repeats across a host's pages judge the blocks, with markup as one signal.

Each page becomes a stream of blocks.  Blocks inside elements that are furniture by their name,
role or class (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) never
count.  All others stay unless they repeat over the pages of their host, whether or not the page
has an article.  The words outside articles of all pages of a host are the token streams: a suffix
of a stream is named by its next ``DEPTH`` words, suffixes with equal names on distinct pages are
repeated substrings of that length or more (the neighbours in a suffix array whose common prefix
is as long), and blocks outside articles that are mostly covered by substrings on more than a
tenth of the host's pages are removed; other runs stay.  Blocks inside ``article`` or ``main`` are
kept by their markup unless the whole block stands in the articles of more than half of the host's
pages, three at least: an article that a host publishes twice is no furniture.  Names are grouped
by a map-side combined aggregation instead of sorting a host's suffixes, so that a host with a
third of all pages is no task of its own.

Edge cases: null or empty html gives the empty text; a null url is a host of its own; repeated
rows give repeated results and, being one page's copies, do not make each other furniture if they
share page_id and url; unclosed elements, comments and cut-off tags end where a browser ends them;
an empty table gives no rows; extra columns are not used.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm import common

#: Words that name a suffix: shorter repeats are no boilerplate.
DEPTH = 8
#: Share of a block's words that repeats must cover.
COVERED = 0.5
#: Least pages of a host, and the share of its pages to be exceeded, that make a repeat furniture outside and inside articles.
OUTSIDE, INSIDE = (2, 0.1), (3, 0.5)

#: Elements whose content is never shown as text, and furniture by name.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "noscript", "template", "iframe"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "svg", "math", "object", "audio",
             "video", "canvas", "select", "button", "map", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu",
         "menubar", "form"}
#: Parts of a class or id that name furniture.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banners?|cookies?|consent"
    r"|notices?|alerts?|sidebars?|side|menus?|nav|navbar|navigation|breadcrumbs?|headers?|masthead|footers?|comments?"
    r"|replies|discussion|disqus|newsletter|subscribe|signup|login|popups?|modals?|overlay|share|sharing|social"
    r"|related|recommended|widgets?|toolbar|paywall|gdpr)(?:$|[\s_-])", re.I)
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BREAKS = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
          "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
          "table", "tbody", "tfoot", "thead", "tr", "ul"}
SPACES = {"br", "td", "th", "img", "input", "option"}
#: An opening tag ends an open element of the same group.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"article", "main", "section", "div", "table", "ul", "ol", "dl", "body", "html", "td", "th", "blockquote",
          *FURNITURE}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

ASIDE, MAIN, OTHER = 0, 1, 2


def _is_furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if value.lower() in ROLES if name.lower() == "role" else NAMES.search(value):
            return True
    return False


class _Page:
    """Open elements and finished blocks of one page."""

    def __init__(self, source: str):
        self.source, self.blocks, self.parts = source, [], []
        self.open: list[tuple[str, bool, bool]] = []  # tag, inside furniture, inside an article

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            _, aside, main = self.open[-1] if self.open else ("", False, False)
            self.blocks.append((text, ASIDE if aside else MAIN if main else OTHER))

    def close(self, tags: set[str], within: set[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                if any(t in BREAKS for t, *_ in self.open[i:]):
                    self.flush()
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def unclosed(self, tag: str) -> bool:
        return len(re.findall(rf"<{tag}\b", self.source, re.I)) > len(re.findall(rf"</{tag}\b", self.source, re.I))

    def start(self, tag: str, attributes: str) -> None:
        if tag in ENDS:
            self.close(ENDS[tag], SCOPES - ENDS[tag])
        elif tag in BREAKS:
            self.close({"p"}, SCOPES)
        if tag in BREAKS:
            self.flush()
        elif tag in SPACES:
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in ("article", "main") and self.open and self.open[-1][1]:
            # Furniture that was never closed does not hold the article that follows.
            first = next(i for i, x in enumerate(self.open) if x[1])
            if self.unclosed(self.open[first][0]):
                del self.open[first:]
        _, aside, main = self.open[-1] if self.open else ("", False, False)
        self.open.append((tag, aside or _is_furniture(tag, attributes), main or tag in ("article", "main")))

    def read(self) -> list[tuple[str, int]]:
        source, at = self.source, 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            self.parts.append(markup.unescape(source[at:m.start() if m else len(source)]))
            if not m:
                break
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                if tag == "br":
                    self.parts.append(" ")
                else:
                    self.close({tag})
            elif m[2] and m[4]:
                tag = m[2].lower()
                if tag in RAW:
                    end = re.compile(rf"</{tag}\s*/?>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                else:
                    self.start(tag, m[3])
        self.flush()
        return self.blocks


def blocks_of(source: str) -> list[tuple[str, int]]:
    """(text, ASIDE, MAIN or OTHER) of a page's blocks, in page order."""
    return _Page(source).read()


def suffix_names(blocks: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each word outside articles: a name of the suffix that starts there, and the word's block."""
    words = [(w, i) for i, (text, kind) in enumerate(blocks) if kind != MAIN for w in text.split()]
    codes = np.array([xxhash.xxh64_intdigest(w) for w, _ in words] + [0] * (DEPTH - 1), np.uint64)
    names = np.zeros(len(words), np.uint64)
    for k in range(DEPTH):
        names = (names * np.uint64(0x9E3779B97F4A7C15)) ^ codes[k:k + len(words)]
        names ^= names >> np.uint64(29)
    return names.view(np.int64), np.array([i for _, i in words], np.int32)


def marks_of(blocks: list[tuple[str, int]]) -> list[int | None]:
    """For each block inside articles a name of its text."""
    return [xxhash.xxh64_intdigest(t) - 2**63 if k == MAIN else None for t, k in blocks]


def _streams(sources: list[str]) -> list[list]:
    pages = [blocks_of(x) for x in sources]
    named = [suffix_names(p) for p in pages]
    return [[[t for t, _ in p] for p in pages], [[k for _, k in p] for p in pages],
            [n for n, _ in named], [o for _, o in named], [marks_of(p) for p in pages]]


def _repeated(names: DataFrame, hosts: DataFrame, least: int, share: float) -> DataFrame:
    """(host, name) of the names on so many pages of their host and on more than this share of them."""
    found = names.where("name is not null").distinct().groupBy("host", "name").count().where(F.col("count") >= least)
    return found.join(hosts, "host").where(F.col("count") > share * F.col("pages")).select("host", "name")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page: blocks joined by an empty line."""
    keyed = common.with_row_key(pages).select(
        "page_id", "url", *common.ROW_KEY, common.whole_text("html").alias("__cl_html"))
    streams = common.written(common.with_python(
        keyed, "__cl_html", lambda: _streams,
        "texts array<string>, kinds array<int>, names array<bigint>, owners array<int>, marks array<bigint>"), "streams", texts=True)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "^[^:/?#]+://([^/?#:]*)", 1)).alias("host")
    page = F.xxhash64("page_id", "url").alias("page")
    hosts = common.shared_small(streams.select(host, page).distinct().groupBy("host").agg(F.count("*").alias("pages")))

    furniture = _repeated(streams.select(host, page, F.explode("names").alias("name")), hosts, *OUTSIDE)
    open_pages = streams.where(F.exists("kinds", lambda k: k == OTHER))
    spots = open_pages.select(host, *common.ROW_KEY, F.posexplode("names").alias("at", "name"))
    covered = spots.join(furniture, ["host", "name"]).groupBy(*common.ROW_KEY).agg(F.collect_list("at").alias("starts"))
    hit = open_pages.select(*common.ROW_KEY, "kinds", "owners").join(covered, common.ROW_KEY).withColumn(
        "hit", F.array_distinct(F.flatten(F.transform(
            "starts", lambda s: F.sequence(s, F.least(s + DEPTH - 1, F.size("owners") - 1))))))
    hit = hit.withColumn("hit", F.transform("hit", lambda i: F.get("owners", i))).select(
        *common.ROW_KEY, "hit", "owners", F.posexplode("kinds").alias("block", "kind")).where(F.col("kind") == OTHER)
    size = lambda words: F.size(F.filter(words, lambda o: o == F.col("block")))
    outside = hit.where(size("hit") > COVERED * size("owners")).select(*common.ROW_KEY, "block")

    blocks = streams.select(host, page, *common.ROW_KEY, F.posexplode("marks").alias("block", "name"))
    inside = blocks.join(_repeated(blocks.select("host", "page", "name"), hosts, *INSIDE), ["host", "name"])
    gone = common.shared_small(outside.unionByName(inside.select(*common.ROW_KEY, "block")).groupBy(*common.ROW_KEY).agg(
        F.collect_set("block").alias("gone")))
    use = F.transform("kinds", lambda k, i: (k != ASIDE) & ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    judged = streams.join(gone, common.ROW_KEY, "left").withColumn("use", use)
    text = F.array_join(F.transform(F.filter(F.arrays_zip("texts", "use"), lambda x: x["use"]), lambda x: x["texts"]), "\n\n")
    return judged.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
