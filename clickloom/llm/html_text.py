"""Main text of web pages by a suffix array over the pages of a host.

Pages are parsed once, where they lie, into blocks.  In an element that declares itself a menu, header,
footer, side bar, notice, advert, form, comment and the like they go, repeated or not: hosts with
one page have nothing to compare.  The token streams of the other blocks make up the host's suffix array as deep as
``repeat`` tokens: each position is a suffix, known by its host and its leading tokens, and the array is cut into ranges
of these keys, each sorted in a task of its own (see ``exchange``), so that a host may hold any share of all
pages.  Equal neighbours count the distinct pages that hold a run of tokens; pages of equal text count as one page
together, each with its part.  Runs that continue each other make long repeated substrings.

* A block of a declared article is boilerplate if nearly all of it (``covered``) lies in runs that stand on ``template``
  of the host's distinct pages and on ``least_pages`` at least; it goes unless half of the article would go, as
  then the article itself has been copied.  Other blocks of such a page go, unless those that no other page holds have more words
  than the article: then it is a teaser and the page is read as one without an article.
* Without a declared article, blocks go where half of their tokens or more lie in runs that another page holds.  If
  nothing is left (a copy of another page), blocks of ten words or more stay, or else all.

Nothing but totals reaches the driver.

Text: character references decoded, white space inside a block one space, trimmed,
blocks joined by a line feed.

Defined cases: null html gives an empty text; broken markup, open elements and cut pages are read as
far as they go; a null url is a host of its own; repeated rows give a row each; an
empty table gives an empty result; extra columns are ignored; a very long page makes its block of pages longer.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .exchange import MESSAGE, SENT, exchanged, followed, in_blocks, messages, ranked, received, rows_of

DECLARED, ARTICLE, OPEN = 0, 1, 2
# Elements without text of their own, elements that start a block, elements and names that are not main text.
RAW = "script|style|title|noscript|template|svg|iframe|object|textarea|select|button|math|canvas|audio|video"
BLOCKS = set(
    "address article aside blockquote body br-block caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = set("nav aside footer form menu dialog head".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|newsletter|subscribe|popup|modal|sidebar|side-?bar|menu|nav|navbar|"
    r"navigation|breadcrumbs?|footer|masthead|site-?header|page-?header|comments?|replies|respond|sharing|widget|pagination|toolbar)(?:$|[\s_-])"
    # these name a part only alone or with a word for a part of a page: "search-results" holds text
    r"|(?:^|\s)(?:notices?|alert|share|social|related|recommended|login|signup|search)"
    r"(?:[_-]?(?:box|bar|form|links?|buttons?|icons?|panel|block|list|area|posts?|articles?|stories|message))?(?:$|\s)",
    re.I,
)
#: Names that tell a part of the page outside an article; within one they may name its matter.
PAGE_NAMES = re.compile(r"(?:^|\s)(?:(?:site|page|top|bottom|cookie|ads?)[_-])?(?:banner|copyright|disclaimer)(?:[_-]?(?:box|bar|text|notice|area|block|line))?(?:$|\s)", re.I)
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _aside(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in ASIDE or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("body", "html", "main"):
        return False
    names = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attrs))
    return bool(names and (NAMES.search(names) or not in_article and PAGE_NAMES.search(names))) or bool(HIDDEN.search(attrs))


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page, in page order."""
    page, found, parts = page or "", [], []
    aside: list[str] = []  # open elements from the declared one on: its name, once for each nesting of that name
    articles = 0
    kind = OPEN

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((kind, text))

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag not in BLOCKS:
            if tag == "br":
                parts.append(" ")
            if not aside and not m["end"] and tag not in VOID and m["attrs"] and _aside(tag, m["attrs"], articles > 0):
                close()
                aside, kind = [tag], DECLARED
            elif aside and tag == aside[0]:
                close()
                aside = aside[:-1] if m["end"] else [*aside, tag]
                kind = DECLARED if aside else ARTICLE if articles else OPEN
            continue
        close()
        if m["end"]:
            if aside:
                if tag == aside[0]:
                    aside.pop()
            elif tag in ("article", "main"):
                articles = max(0, articles - 1)
        elif tag not in VOID:
            if aside:
                if tag == aside[0]:
                    aside.append(tag)
                elif tag in ("article", "main") and not _aside(tag, m["attrs"], False):
                    aside, articles = [], articles + 1  # an element left open does not swallow the article
            elif _aside(tag, m["attrs"], articles > 0):
                aside = [tag]
            elif tag in ("article", "main"):
                articles += 1
        kind = DECLARED if aside else ARTICLE if articles else OPEN
    parts.append(page[at:])
    close()
    return found


SIGNATURE, WINDOW, HOST, SHOWN, UNDECLARED = range(1, 6)
#: A distinct page counts as so many parts; pages of equal text share them.
PARTS = 1 << 20


class Pages:
    """The token streams of a block of pages."""

    def __init__(self, table: pa.Table, repeat: int, bits: int):
        self.kinds, self.texts = (table.column(c).to_pylist() for c in ("kinds", "texts"))
        hosts = table.column("host").to_pylist()
        self.host = np.array([xxhash.xxh64_intdigest(h) for h in hosts], np.uint64)
        self.signature = followed(self.host, np.array([xxhash.xxh64_intdigest("\n".join(t)) for t in self.texts], np.uint64))
        self.windows = []
        for host, texts in zip(self.host, self.texts):
            tokens = [t for text in texts for t in text.split(" ")]
            h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
            key = np.full(max(0, len(h) - repeat + 1), host)
            for i in range(repeat):
                key = followed(key, h[i : len(key) + i])
            self.windows.append(key >> np.uint64(64 - bits))

        self.undeclared = np.array([ARTICLE not in k and len(k) > 0 for k in self.kinds], np.int64)

    def counts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(family, keys, counts): pages by signature, pages by host, and those of them without a declared article."""
        for family, key, own in ((SIGNATURE, self.signature, 1), (SHOWN, self.host, 1), (UNDECLARED, self.host, self.undeclared)):
            keys, place, _ = ranked(key)
            yield family, keys, np.bincount(place, np.broadcast_to(own, len(place)), len(keys))


def _covered(pages: np.ndarray, n: int, least: float, repeat: int) -> np.ndarray:
    """Which of n tokens lie in a run of ``repeat`` tokens that ``least`` pages hold; ``pages[i]`` hold that at i."""
    steps = np.zeros(n + repeat + 1, np.int64)
    at = np.nonzero(pages >= least)[0]  # none where the host's pages are too few to be counted
    np.add.at(steps, at, 1)
    np.add.at(steps, at + repeat, -1)
    return np.cumsum(steps)[:n] > 0


def main_text(kinds: list[int], texts: list[str], pages: np.ndarray, host_pages: float, repeat: int, template: float, least_pages: int, covered: float) -> str:
    """The main text of a page; ``pages[i]`` is the number of distinct pages of the host with the run of ``repeat`` tokens at i."""
    sizes = [text.count(" ") + 1 for text in texts]
    ends = np.cumsum(sizes)
    inside = lambda least: [c[e - k : e].mean() for c in [_covered(pages, int(ends[-1]), least, repeat)] for e, k in zip(ends, sizes)]
    if not texts:
        return ""
    every = sum(n for n, kind in zip(sizes, kinds) if kind == ARTICLE)
    outside = sum(sizes) - every
    share = inside(1.99) if outside > every or not every else []
    if every and (outside <= every or sum(n for n, kind, x in zip(sizes, kinds, share) if kind == OPEN and x < 0.5) <= every):
        share = inside(max(least_pages, template * host_pages) - 0.01)
        common = [kind == ARTICLE and x >= covered for kind, x in zip(kinds, share)]
        gone = sum(n for n, c in zip(sizes, common) if c)
        return "\n".join(text for kind, text, c in zip(kinds, texts, common) if kind == ARTICLE and not (c and 2 * gone < every))
    unique = [text for text, x in zip(texts, share) if x < 0.5]
    return "\n".join(unique or [text for text, n in zip(texts, sizes) if n >= 10] or texts)


def html_text(
    pages: DataFrame,
    repeat: int = 6,
    template: float = 0.3,
    least_pages: int = 4,
    covered: float = 0.9,
    block_bytes: int = 16 << 20,
    range_keys: int = 2_000_000,
) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(k, t) for k, t in blocks(x.as_py()) if k != DECLARED] for x in batch.column(3)]
            kinds = pa.array([[k for k, _ in page] for page in found], pa.list_(pa.int32()))
            texts = pa.array([[t for _, t in page] for page in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], kinds, texts], names=["page_id", "url", "host", "kinds", "texts"])

    parsed = rows.mapInArrow(parse, "page_id long, url string, host string, kinds array<int>, texts array<string>")
    held = in_blocks(parsed, n_rows, n_bytes, block_bytes)
    n_tokens = max(1, n_bytes // 5)
    bits = min(64, max(40, math.ceil(math.log2(n_tokens)) + 14))
    ranges = max(1, n_tokens // range_keys)

    def number(table: pa.Table) -> int:
        return table.column("block")[0].as_py()

    def sign(table: pa.Table) -> pa.Table:
        found = [messages(number(table), family, keys, n, None, 64, ranges) for family, keys, n in Pages(table, repeat, bits).counts()]
        return rows_of([*chain.from_iterable(found)], MESSAGE)

    signed = staged(exchanged(held.groupBy("block").applyInArrow(sign, SENT)), "signatures")

    def asked(own: Pages, told: pa.Table) -> Pages:
        """Without the windows of hosts that have too few pages for any block to go."""
        place = ranked(own.host)[1]
        n, undeclared = received(told, SHOWN)[place], received(told, UNDECLARED)[place]
        own.windows = [w if k >= least_pages or (k >= 2 and u) else w[:0] for w, k, u in zip(own.windows, n, undeclared)]
        return own

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        own = Pages(table, repeat, bits)
        part = np.maximum(np.rint(PARTS / received(told, SIGNATURE)[ranked(own.signature)[1]]), 1)
        once = [np.unique(w) for w in asked(own, told).windows]
        found = []
        for family, key, parts, width in (
            (WINDOW, np.concatenate(once), np.repeat(part, [len(w) for w in once]), bits),
            (HOST, own.host, part, 64),
        ):
            keys, place, _ = ranked(key, width)
            found += messages(number(table), family, keys, np.bincount(place, parts, len(keys)), None, width, ranges)
        return rows_of(found, MESSAGE)

    counted = staged(exchanged(held.groupBy("block").cogroup(signed.groupBy("block")).applyInArrow(send, SENT)), "windows")

    def extract(table: pa.Table, told: pa.Table) -> pa.Table:
        own = asked(Pages(table, repeat, bits), told)
        n = (received(told, WINDOW) / PARTS)[ranked(np.concatenate(own.windows), bits)[1]]
        ends = np.cumsum([len(w) for w in own.windows])
        hosts = (received(told, HOST) / PARTS)[ranked(own.host)[1]]
        texts = [
            main_text(kinds, texts, n[end - len(w) : end], host_pages, repeat, template, least_pages, covered)
            for kinds, texts, w, end, host_pages in zip(own.kinds, own.texts, own.windows, ends, hosts)
        ]
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return held.groupBy("block").cogroup(signed.union(counted).groupBy("block")).applyInArrow(extract, "page_id long, url string, text string, n_chars long")
