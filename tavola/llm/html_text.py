"""HTML extraction (operator 7): consensus host paths.

Every page's containers (structural elements, named by a generalised path of
tags, classes and ids) are scored by the running text in them; Spark counts
the pages of a host that rank a path first and picks the host's winning path;
every page is read again and its text taken from the containers on that path.
A page without such a container uses its own best one.  Where containers of
other classes beside it go on with the article, the one around them all counts.

A block ends at every tag that is not inline.  Menus, headers and footers of
the page, sidebars, notices, adverts, forms, scripts, styles and reader
comments are told by tag, class, id or role and give no text, except where
the element itself is the winning container.

Cases: null or empty html gives an empty text; a url that is null or has no
host falls into one host of its own name, so such pages vote together; broken
markup closes what is open, and a page is read in one pass whatever is broken in it; repeated page ids are read each for itself; other
columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.shared import written

_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NUMBER = re.compile(r"\d+")
_CUE = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# fixed values
CONTAINERS = frozenset("html body div section article main aside nav header footer form table tbody thead tfoot tr td th ul ol dl figure "
                       "fieldset details dialog center blockquote menu address hgroup search".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub "
                   "sup time tt u var wbr label img input picture source".split())
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE_TAGS = frozenset("nav aside footer form menu dialog search".split())
SIDE_CUES = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead ad ads advert adverts advertisement "
                      "advertising sponsor sponsored promo promoted banner cookie cookies consent notice notices gdpr popup modal overlay comment "
                      "comments disqus replies share sharing social related recommended newsletter subscribe signup login widget pagination "
                      "pager toolbar skip copyright".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FREE = frozenset("html body main".split())  # never left out for a class
RUNNING = 80  # characters from which on a block is running text


def _describe(tag: str, attributes: str) -> tuple[str, bool]:
    """Generalised name of an element, and whether it stands beside the main text."""
    names, side = [], tag in SIDE_TAGS
    if attributes:
        for kind, a, b, c in _ATTRIBUTE.findall(attributes):
            value = (a or b or c).strip()
            kind = kind.lower()
            if kind == "role":
                side |= value.lower() in SIDE_ROLES
                continue
            words = sorted(set(value.split()))
            names += [("." if kind == "class" else "#") + _NUMBER.sub("0", w) for w in words]
            side |= any(cue in SIDE_CUES for w in words for cue in _CUE.findall(_CAMEL.sub(" ", w).lower()))
    return tag + "".join(names), side and tag not in FREE


def tokens(page: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """(text, None, False, "") of texts, ("", tag, closing, attributes) of tags; comments
    and declarations are left out.  One pass over the page, whatever is broken in it.

    A quote without a partner is part of its tag, which ends at the next ``>``; so is
    one whose partner opens another attribute's value, with a ``>`` in between.  A tag
    that never ends is left out.  What scripts and the like hold is not read as tags."""
    at, end = 0, len(page)
    last = page.rfind(">")
    alone = {'"': end, "'": end}  # from here on no such quote follows
    while at < end:
        lt = page.find("<", at)
        if lt != at:
            yield page[at: lt if lt >= 0 else end], None, False, ""
            if lt < 0:
                return
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = close + 1 if close >= 0 else end
            continue
        name = _NAME.match(page, lt)
        if name is None:
            yield "<", None, False, ""
            at = lt + 1
            continue
        at = name.end()
        if lt > last:
            continue
        while True:
            stop = _STOP.search(page, at)
            if stop is None or page[stop.start()] == ">":
                break
            q, begin = stop[0], stop.end()
            close = page.find(q, begin) if begin < alone[q] else -1
            if close < 0:
                alone[q] = min(alone[q], begin)
                at = begin
                continue
            value = page[begin:close]
            if ">" in value and value.rstrip().endswith("="):
                stop = _STOP.search(page, page.find(">", begin))
                break
            at = close + 1
        close = stop.start() if stop is not None else end
        tag, closing = name[0].lstrip("</").lower(), name[0][1] == "/"
        yield "", tag, closing, page[name.end(): close]
        at = close + 1
        if tag in _RAW_END and not closing and page[close - 1: close] != "/":
            raw = _RAW_END[tag].search(page, at)
            at = raw.start() if raw else end


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], int, str, int]]:
    """(path of containers, depth of the innermost that stands aside or 0, text,
    characters in links) of every block, in page order."""
    stack: list[tuple[str, str, bool]] = []  # tag, name, aside
    path: tuple[str, ...] = ()
    aside = 0
    text: list[str] = []
    link = linked = 0
    silent = ""

    def flush():
        nonlocal linked
        if text:
            raw = "".join(text)
            whole = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
            text.clear()
            n, linked = linked, 0
            if whole:
                return (path, aside, whole, min(n, len(whole)))
        return None

    def moved():
        nonlocal path, aside
        path = tuple(s[1] for s in stack)
        aside = max((i + 1 for i, s in enumerate(stack) if s[2]), default=0)

    for t, tag, closing, attributes in tokens(page):
        if tag is None:
            if not silent:
                text.append(t)
                if link:
                    linked += len(t)
            continue
        if silent:
            if closing and tag == silent:
                silent = ""
            continue
        if tag in SILENT:
            if tag not in ("head", "title") and not closing and not attributes.endswith("/"):
                silent = tag
            elif tag in ("head", "title") and not closing:
                silent = tag
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            continue
        got = flush()
        if got:
            yield got
        link = 0
        if tag in CONTAINERS:
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        moved()
                        break
            elif not attributes.endswith("/"):
                name, side = _describe(tag, attributes)
                if tag == "header" and not any(s[0] in ("article", "main") for s in stack):
                    side = True
                stack.append((tag, name, side))
                moved()
    got = flush()
    if got:
        yield got


def best_path(page: str) -> tuple[str, float] | None:
    """The path of the page's best container and its score: a block counts for
    its container, for the one around it by half and around that by a quarter."""
    score: dict[tuple[str, ...], float] = {}
    for path, aside, text, linked in blocks(page):
        if aside or not path:
            continue
        value = len(text) - 2.0 * linked
        if _weight(text, linked):
            value *= 1.5
        for up in range(min(3, len(path))):
            p = path[: len(path) - up]
            score[p] = score.get(p, 0.0) + value / 2 ** up
    if not score:
        return None
    path, value = max(score.items(), key=lambda x: (x[1], -len(x[0]), x[0]))
    return "/".join(path), value


def _weight(text: str, linked: int) -> int:
    """Characters of running text in a block."""
    return len(text) if len(text) >= RUNNING and linked * 5 < len(text) else 0


def whole_article(found: list[tuple], path: tuple[str, ...]) -> tuple[str, ...]:
    """The path, or one above it if containers beside it hold the article's other parts:
    running text of a quarter of its own or more, none of it standing aside."""
    while len(path) > 1:
        above, by = path[:-1], {}
        for own, aside, text, linked in found:
            if not aside and len(own) >= len(path) and own[: len(above)] == above:
                by[own[: len(path)]] = by.get(own[: len(path)], 0) + _weight(text, linked)
        if not any(other != path and n and 4 * n >= by.get(path, 0) for other, n in by.items()):
            break
        path = above
    return path


def main_text(page: str, winner: str | None) -> str:
    """Blocks on the winning path, or on the page's own best, and of the containers
    beside it that go on with the article."""
    found = list(blocks(page))

    def take(way: str) -> list[str] | None:
        want = tuple(way.split("/"))
        if not any(path[: len(want)] == want for path, *_ in found):
            return None
        inside = [text for path, aside, text, _ in found if path[: len(want)] == want and aside <= len(want)]
        wide = whole_article(found, want)
        return inside if wide == want else [text for path, aside, text, _ in found if path[: len(wide)] == wide and not aside]

    got = take(winner) if winner else None
    if got is None:
        own = best_path(page)
        got = take(own[0]) if own else []
    return "\n".join(got or [])


def host_of(url: str):
    """Host of the url column, lower-case, without port; null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages(page_id, url, html)."""
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("_host", F.coalesce(host_of("url"), F.lit("")))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths, values = [], [], []
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                got = best_path(page.as_py() or "")
                if got:
                    hosts.append(host)
                    paths.append(got[0])
                    values.append(got[1])
            yield pa.record_batch({"host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string()), "score": pa.array(values, pa.float64())})

    voted = pages.select("_host", "html").mapInArrow(votes, "host string, path string, score double")
    counted = voted.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score").cast("long")).alias("s"))
    # written first: its size is then known, and Spark broadcasts it only if it is small
    winners = written(counted.groupBy("host").agg(F.max_by("path", F.struct("n", "s", "path")).alias("winner")), "host-paths")

    kinds = dict(pages.dtypes)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(page.as_py() or "", w) for page, w in zip(b.column(2), b.column(3).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    joined = pages.join(winners, pages["_host"] == winners["host"], "left").select("page_id", "url", "html", "winner")
    return joined.mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
