"""Main text of web pages: markup first, a host suffix array for what markup leaves open.

A page is read as blocks of text with the elements around them. Blocks under menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles or reader comments (by element, or by a class, id or role that says nothing else) are boilerplate; if the page
has an article (or else a main element), its other blocks are the text, but for those under a class, id or role that only partly
sounds like boilerplate: these are open. Where a page marks neither article nor main, all its other blocks are open.

For open blocks repetition decides. The token streams of a host's pages, all but the sure text, are concatenated; suffixes are grouped
by their first RUN tokens (what stands next to each other in a suffix array and shares RUN tokens at least; a short block counts with
its end as one suffix), and a beginning that stands on enough distinct pages of the host (SHARE of them, two at least; for a short
block SHORT_SHARE) marks a repeated run. Longer repeated passages are chains of such beginnings. Tokens of open blocks that repeated
runs cover are removed, the unique runs stay. Spark does the grouping and counts pages by (host, beginning, page) first, so neither a
large host nor a line on all of its pages meets in one task. Sure text is never removed for being repeated, since copies of an article
occur on a host.

Null html counts as empty, its text is empty. Unclosed and cut-off markup is read as far as it goes, in time that grows with the page's
length only; very long pages are read whole. A null url is a host of its own name ''. Repeated rows and exact copies count as one page;
an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, text_of, written

RUN, SHARE, SHORT_SHARE = 8, 0.1, 0.5
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>]++)))?+")
#: HTML element names, and names of classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr label".split())
BOILER_TAGS = frozenset("nav header footer aside form menu button dialog head".split())
BOILER_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo "
    "cookie cookies consent gdpr notice notices alert disclaimer comment comments respond disqus newsletter subscribe subscription signup login popup modal "
    "overlay breadcrumb breadcrumbs pagination pager related recommended share sharing social widget toolbar search contentinfo complementary skip toc".split()
)
#: Words that may stand beside these in a name without changing what it says.
FILLERS = frozenset("site page main global top bottom left right container wrapper wrap box list item items block section area inner outer row bar links form unit slot post user primary secondary mobile desktop js".split())
#: Elements whose content is no text; of those in EMPTY a tag that ends in / is all.
SKIPPED = frozenset("script style noscript template svg iframe textarea select title object canvas audio video".split())
EMPTY = frozenset("svg iframe object canvas audio video".split())
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SKIPPED}


def marks(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag, comment or skipped element; the name is empty where nothing but the place counts.

    Script and style run to the end of the page where no end tag follows; of other skipped elements only the opening tag is skipped then.
    A tag that breaks off ends at the next < or >, or with the page."""
    at, n, after = 0, len(page), -1  # after: the next > is there
    endless: set[str] = set()
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        kind = page[at : at + 1]
        if page.startswith("!--", at):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, False, "", ""
        elif m := _TAG.match(page, start):
            at, name = m.end(), m[2].lower()
            if m[1] or name not in SKIPPED:
                yield start, at, bool(m[1]), name, m[3]
                continue
            if name not in endless and not (m[3].endswith("/") and name in EMPTY):
                if end := _ENDS[name].search(page, at):
                    at = end.end()
                elif name in ("script", "style"):
                    at = n
                else:
                    endless.add(name)
            yield start, at, False, "", ""
        elif kind and (kind in "!?/" or (kind.isascii() and kind.isalpha())):
            if after < at:
                after = page.find(">", at)
                after = n if after < 0 else after
            following = page.find("<", at)
            at = min(after + 1, n if following < 0 else following, n)
            m = _NAME.match(page, start) if after < at else None
            yield start, at, bool(m and m[1]), m[2].lower() if m and m[2].lower() not in SKIPPED else "", page[m.end() : at - 1] if m else ""


def blocks(page: str) -> list[tuple[str, bool, str]]:
    """(place, doubtful, text) of each block in page order; the place is article, main, open or boiler."""
    out: list[tuple[str, bool, str]] = []
    stack: list[tuple[str, str, bool]] = []
    held: list[str] = []
    place, doubtful, at = "open", False, 0

    def close() -> None:
        text = " ".join(_html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((place, doubtful, text))

    def leave(depth: int) -> tuple[str, bool]:
        del stack[depth:]
        return stack[-1][1:] if stack else ("open", False)

    for start, end, closing, tag, attributes in marks(page):
        if start > at:
            held.append(page[at:start])
        at = end
        if not tag or tag in INLINE:
            continue
        close()
        if tag in VOID:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                place, doubtful = leave(depth)
            continue
        if attributes.endswith("/"):
            continue
        # an open paragraph or item ends where the next begins, the head where the body does
        if stack and ((tag in ("p", "li") and stack[-1][0] == tag) or (tag == "body" and stack[-1][0] == "head")):
            place, doubtful = leave(len(stack) - 1)
        if place != "boiler":
            sure = _boiler(tag, attributes, place)
            if sure == 1:
                place, doubtful = "boiler", False
            elif tag == "article" or (tag == "main" and place == "open"):
                place = tag
            doubtful = doubtful or (0 < sure < 1)
        stack.append((tag, place, doubtful))
    if at < len(page):
        held.append(page[at:])
    close()
    return out


def _attributes(raw: str) -> dict[str, str]:
    """An element's attributes by lower-case name, values as they stand; of a name that comes twice, the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _boiler(tag: str, attributes: str, place: str) -> float:
    """1: boilerplate, 0: not, between: repetition decides. An article's own header is not a page's."""
    if tag == "header" and place == "article":
        return 0
    if tag in BOILER_TAGS:
        return 1
    if not attributes or tag in ("body", "html", "article", "main"):
        return 0
    named = _attributes(attributes)
    # a class called hidden says little: it often stands beside one that shows the element on wide screens
    if "hidden" in named or named.get("aria-hidden", "").strip().lower() == "true":
        return 1
    found = 0.0
    for key in ("class", "id", "role"):
        for name in named.get(key, "").lower().split():
            parts = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            if not BOILER_NAMES.isdisjoint(parts):
                whole = all(w in BOILER_NAMES or w in FILLERS for w in parts)
                if whole and not (place == "article" and "header" in parts):
                    return 1
                found = 0.5
    return found


def settled(found: list[tuple[str, bool, str]]) -> tuple[list[tuple[bool, str]], list[str]]:
    """((open, text) of the blocks that may be text, the other blocks)."""
    main = next((k for k in ("article", "main") if any(place == k for place, _, _ in found)), None)
    own = [(doubtful or not main, text) for place, doubtful, text in found if place == (main or "open")]
    return own, [text for place, _, text in found if place != (main or "open")]


def _host():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _host().alias("_host"), text_of("html").alias("_html"))


def beginnings(own: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, tokens, hash) of the first RUN tokens of every suffix of the blocks' stream, and of every shorter block with its end."""
    sizes = np.array([len(b) for b in own], np.int64)
    h = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) for b in own for t in b], np.uint64)

    def mixed(at: np.ndarray, n: int, salt: int) -> np.ndarray:
        out = np.full(len(at), salt, np.uint64)
        for i in range(n):
            out = (out ^ h[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    at, n = [np.arange(max(0, len(h) - RUN + 1))], [np.full(max(0, len(h) - RUN + 1), RUN)]
    hashes, first = [mixed(at[0], RUN, 0)], np.cumsum(sizes) - sizes
    for size in range(1, RUN):
        short = first[sizes == size]
        at.append(short)
        n.append(np.full(len(short), size))
        hashes.append(mixed(short, size, size))
    return np.concatenate(at), np.concatenate(n), np.concatenate(hashes)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (hash of the content), blocks (open, text), and at, n, head: the beginnings of suffixes in the page's stream, that
    of the open blocks and then that of the sure boilerplate, where at is -1."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, 3)):
            page, own, at, n, head = [], [], [], [], []
            for source in part.column(3).to_pylist():
                page.append(xxhash.xxh64_intdigest(source.encode("utf-8", "replace")) - (1 << 63))
                kept, other = settled(blocks(source))
                own.append([{"open": o, "text": t} for o, t in kept])
                a, b = (beginnings([t.split() for t in x]) for x in ([t for o, t in kept if o], other))
                at.append(np.r_[a[0], np.full(len(b[0]), -1)].tolist())
                n.append(np.r_[a[1], b[1]].tolist())
                head.append(np.r_[a[2], b[2]].tolist())
            kinds = (pa.int64(), pa.list_(pa.struct([("open", pa.bool_()), ("text", pa.string())])), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x, k) for x, k in zip((page, own, at, n, head), kinds, strict=True))], names=["page_id", "url", "host", "page", "blocks", "at", "n", "head"])

    return _rows(pages).mapInArrow(read, "page_id long, url string, host string, page long, blocks array<struct<open:boolean,text:string>>, at array<int>, n array<int>, head array<long>")


def suffixes(found: DataFrame) -> DataFrame:
    """(host, page, at, n, head) of parsed pages, a row per suffix."""
    return found.select("host", "page", F.explode(F.arrays_zip("at", "n", "head")).alias("s")).select("host", "page", "s.at", "s.n", "s.head")


def repeated(found: DataFrame) -> DataFrame:
    """(host, n, head) that enough pages of different content share on a host."""
    pages = found.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    on = found.select("host", "n", "head", "page").distinct().groupBy("host", "n", "head").agg(F.count(F.lit(1)).alias("_on")).where("_on > 1")
    return on.join(pages, "host").where(F.col("_on") >= F.col("_pages") * F.when(F.col("n") < RUN, SHORT_SHARE).otherwise(SHARE)).select("host", "n", "head")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    found = written(parsed(pages), "pages")
    spread = suffixes(found)
    asked = F.exists("blocks", lambda b: b["open"])
    places = suffixes(found.where(asked)).where("at >= 0").join(repeated(spread), ["host", "n", "head"], "left_semi")
    covered = places.groupBy("host", "page").agg(F.collect_set(F.struct("at", "n")).alias("_covered"))
    sure = found.where(~asked).select("page_id", "url", F.array_join(F.transform("blocks", lambda b: b["text"]), " ").alias("text"))

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for own, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                edge = np.zeros(sum(len(b["text"].split()) for b in own if b["open"]) + 1, np.int64)
                for r in runs or ():
                    edge[r["at"]] += 1
                    edge[r["at"] + r["n"]] -= 1
                free, at, out = np.cumsum(edge) == 0, 0, []
                for b in own:
                    if b["open"]:
                        tokens = b["text"].split()
                        out += [t for t, keep in zip(tokens, free[at:], strict=False) if keep]
                        at += len(tokens)
                    else:
                        out.append(b["text"])
                texts.append(" ".join(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    doubtful = found.where(asked).join(covered, ["host", "page"], "left").select("page_id", "url", "blocks", "_covered")
    return sure.union(doubtful.mapInArrow(unique, "page_id long, url string, text string"))


def digest(pages: DataFrame) -> DataFrame:
    """The query's columns."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
