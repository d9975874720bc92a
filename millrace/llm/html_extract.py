"""HTML extraction by nearest-URL page differencing.

Pages are sorted by (host, path). Each is paired with the page of its host, among the REACH before and after it, whose
path shares the longest prefix; a page that is a copy (the lines that both hold carry over two thirds of its characters) tells
nothing of the template, so the next nearest is taken, and none if all are copies. The lines of both are aligned by
longest common subsequence, and those that both hold are deleted as template, unless the page's own markup vouches for them: lines inside an article, main or article body container are
kept (copies of one article on neighbouring urls would otherwise delete each other), and lines inside containers that
are marked as boilerplate (menus, adverts, notices, forms, comments ...) are dropped even if no other page has them. If
a page has a content container, its text is what that container holds.

Pages are parsed first and dealt, as lines, into url ranges at sampled split points; the REACH pages before and after a range are sent along, so
that pairing is exact and a host with a third of all pages is spread over many tasks.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tune
from .url_filter import url_parts

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"=\s*([\"'])|>")
#: Pages before and after a page among which its pair is looked for.
REACH = 3
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Elements whose text is no text of the page.
SILENT = frozenset("script style noscript template iframe svg object canvas audio video select textarea button head".split())
#: Elements that are boilerplate whatever their attributes.
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
CONTENT = frozenset(("article", "main"))
CONTAINERS = frozenset("html body div section article main nav header footer aside form menu dialog ul ol dl table tbody thead tfoot tr td th figure details blockquote center fieldset".split()) | SILENT
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Elements without text of their own that stand inside a line.
_INSIDE = frozenset("script style noscript template svg object canvas audio video select textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id and role that mark boilerplate.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside complementary widget footer contentinfo masthead "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login comment comments disqus "
    "replies respond related recommended share sharing social toolbar pagination pager search dialog".split()
)
#: Parts of class names that say nothing of the content: a name of such parts and a mark is a mark.
NEUTRAL = frozenset("box list links link bar block section container wrapper wrap area top bottom left right upper lower unit item items inner outer text panel site page global main primary secondary mobile desktop header slot row col column grid card group buttons button icons icon form by js u c user users reader readers visitor visitors".split())
#: Elements that stay inside a head; any other ends one that was not closed.
_HEAD = frozenset("head title meta link base script style noscript template".split())
#: Blocks that are looked at only to leave them out. They end where the next block starts.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address".split())
_ALWAYS_OPEN = frozenset(("html", "body", "main"))


@lru_cache(maxsize=4096)
def _role(tag: str, attrs: str) -> str:
    """What an element is by its tag and attributes: drop, content or plain."""
    if tag in SILENT or tag in BOILERPLATE:
        return "drop"
    if not attrs.strip() or tag in ("html", "body"):
        return "content" if tag in CONTENT else "plain"
    given = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)}
    found = {k: v.lower() for k, v in given.items()}
    names = [[w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", x)] for x in " ".join(given.get(k, "") for k in ("class", "id", "role")).split()]
    boiler = any(parts and MARKS & set(parts) and set(parts) <= MARKS | NEUTRAL for parts in names)
    if tag not in _ALWAYS_OPEN and (boiler or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")):
        return "drop"
    if tag in CONTENT or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody":
        return "content"
    return "plain"


def _markup(page: str, at: int, last: int) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, tag, attributes) of each piece of markup from at on; comments and declarations have no
    tag. last: where the page's last > is.

    A tag ends at the first > outside of quoted attribute values; a quote that is never closed is none. A < behind which
    no > follows begins no tag. Each character is looked at a fixed number of times.
    """
    while m := _OPEN.search(page, at):
        start, at = m.start(), m.end()
        if m[1]:
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, False, "", ""
            continue
        if at > last:
            return
        if m[2]:
            at = page.find(">", at) + 1
            yield start, at, False, "", ""
            continue
        pos = at
        while True:
            stop = _STOP.search(page, pos)
            if stop is None:  # the last > is inside a quoted value
                pos = last + 1
                break
            pos = stop.end()
            if stop[1] is None:
                break
            close = page.find(stop[1], pos)
            if close < 0:
                pos = page.find(">", pos) + 1 or last + 1
                break
            pos = close + 1
        yield start, max(pos, at), bool(m[3]), m[4].lower(), page[at : max(pos, at) - 1]
        at = max(pos, at)


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, inside a content container, inside boilerplate) of each block of a page, in page order."""
    out: list[tuple[str, bool, bool]] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []
    buf: list[str] = []
    content = drop = 0

    def flush() -> None:
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                out.append((text, content > 0, drop > 0))

    def pop_to(i: int) -> None:
        nonlocal content, drop
        while len(stack) > i:
            role = stack.pop()[1]
            content -= role == "content"
            drop -= role == "drop"

    at = 0
    size = len(page)
    last = page.rfind(">")
    pieces = _markup(page, 0, last)
    while at < size:
        start, end, closes, tag, attrs = next(pieces, (size, size, False, "", ""))
        if not (stack and stack[-1][0] in SILENT):
            buf.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag not in INLINE and tag not in _INSIDE:
            flush()
        if closes:
            if tag in CONTAINERS:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if i is not None:
                    pop_to(i)
            elif stack and stack[-1][0] == tag:
                pop_to(len(stack) - 1)
            continue
        if stack and stack[-1][0] == "head" and tag not in _HEAD:
            pop_to(len(stack) - 1)
            buf.clear()
        if stack and stack[-1][0] in _LEAVES and tag not in INLINE and tag not in VOID:
            pop_to(len(stack) - 1)
        if tag in VOID or attrs.endswith("/") and tag not in CONTAINERS:
            continue
        role = _role(tag, attrs)
        if tag in ("header",) and not content:
            role = "drop"
        if tag in CONTENT and role == "content" and drop and stack[-1][0] in ("nav", "header", "div", "ul") and not content:
            pop_to(next(i for i, x in enumerate(stack) if x[1] == "drop"))  # a menu or advert that was never closed
        if tag in CONTAINERS or role == "drop" and tag in _LEAVES:
            stack.append((tag, role))
            content += role == "content"
            drop += role == "drop"
        if tag in SILENT and tag != "head":
            close = _closing(tag).search(page, at)
            at = close.start() if close else size
            pieces = _markup(page, at, last)
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b (bit-parallel rows, traced back)."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        m = where.get(x, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out: set[int] = set()
    j = len(b)
    # a zero bit j of row i says that the LCS of a[:i+1] and b[:j+1] is longer than that of a[:i+1] and b[:j]
    for i in range(len(a) - 1, -1, -1):
        while j > 0 and rows[i] >> (j - 1) & 1:
            j -= 1
        if j == 0:
            break
        above = rows[i - 1] if i else full
        if above >> (j - 1) & 1:
            out.add(i)
            j -= 1
    return out


def is_copy(page: list[str], shared: set[int]) -> bool:
    """Whether the shared lines carry over two thirds of the page's characters."""
    return 3 * sum(len(page[i]) for i in shared) > 2 * sum(map(len, page))


def template(page: list[tuple[str, bool, bool]], near: list[list[tuple[str, bool, bool]]]) -> tuple[set[int], int]:
    """(positions of the page's lines that the nearest page which is no copy holds too, lines shared with the nearest page of all).

    near: neighbours, nearest first.
    """
    own, first = [x for x, _, _ in page], 0
    for k, other in enumerate(near):
        shared = common_lines(own, [x for x, _, _ in other])
        first = len(shared) if k == 0 else first
        if not is_copy(own, shared):
            return shared, first
    return set(), first


def main_text(page: list[tuple[str, bool, bool]], shared: set[int]) -> str:
    """The page's text, given its lines and which of them are template."""
    has = any(c and not d for _, c, d in page)
    return "\n".join(x for i, (x, c, d) in enumerate(page) if not d and (c if has else i not in shared))


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", block_pages: int = 256, max_blocks: int = 4096) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) for every row.

    A null page, or one without content, has an empty text. Null urls belong to an empty host; equal urls are ordered
    by id; repeated rows stay repeated. n_shared: lines that the nearest page holds too.
    """
    tune(df.sparkSession)
    host, path = url_parts(F.col(url))
    d = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host.alias("host"), path.alias("path"))
    key = F.concat_ws("\x01", "host", "path", F.coalesce(F.lpad(F.col("page_id").cast("string"), 20, "0"), F.lit("")))
    d = d.withColumn("key", key)
    n = df.count()
    blocks = min(max_blocks, n // block_pages + 1)
    cuts: list[str] = []
    if blocks > 1:
        share = min(1.0, blocks * 40 / n)
        some = d.select("key").where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
        got = sorted({r.key for r in some.collect()}, key=str)
        cuts = sorted({got[len(got) * i // blocks] for i in range(1, blocks)}) if got else []
    block = lambda k: bisect.bisect_right(cuts, k)
    ends: dict[str, list[int]] = {}
    if cuts:

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([block(k) for k in b.column(0).to_pylist()], pa.int32()), b.column(0)], names=["block", "key"])

        edge = d.select("key").mapInArrow(dealt, "block int, key string")
        up, down = (F.row_number().over(Window.partitionBy("block").orderBy(k)) for k in (F.asc("key"), F.desc("key")))
        edge = edge.select("block", "key", up.alias("up"), down.alias("down")).where((F.col("up") <= REACH) | (F.col("down") <= REACH))
        rows = sorted((r.key, r.block) for r in edge.collect())  # 2 * REACH for each block
        at = [b for _, b in rows]
        for b in sorted(set(at)):
            lo, hi = bisect.bisect_left(at, b), bisect.bisect_right(at, b)
            for k, _ in rows[max(0, lo - REACH) : lo] + rows[hi : hi + REACH]:
                ends.setdefault(k, []).append(b)

    routed = pa.schema([("block", pa.int32()), ("guest", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("lines", pa.list_(pa.string())), ("marks", pa.list_(pa.int8()))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_pylist()
            own = [(i, block(k), False) for i, k in enumerate(keys)]
            own += [(i, t, True) for i, k in enumerate(keys) for t in ends.get(k, ())]
            parsed = [lines(h) for h in b.column("html").to_pylist()]
            at = pa.array([x[0] for x in own], pa.int64())
            cols = [pa.array([x[1] for x in own], pa.int32()), pa.array([x[2] for x in own], pa.bool_())]
            cols += [b.column(c.name).cast(c.type).take(at) for c in list(routed)[2:-2]]
            cols.append(pa.array([[x[0] for x in p] for p in parsed], pa.list_(pa.string())).take(at))
            cols.append(pa.array([[x[1] + 2 * x[2] for x in p] for p in parsed], pa.list_(pa.int8())).take(at))  # content, boilerplate
            yield pa.RecordBatch.from_arrays(cols, schema=routed)

    result = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int64())])

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for r in b.to_pylist():
                    yield r | {"lines": [(t, m & 1 > 0, m & 2 > 0) for t, m in zip(r["lines"], r["marks"])]}

        def finish(before, cur, after):
            near = [(_prefix(x["path"], cur["path"]), -i, x["lines"]) for side in (before[::-1], after) for i, x in enumerate(side) if x["block"] == cur["block"] and x["host"] == cur["host"]]
            near.sort(key=lambda x: x[:2], reverse=True)
            shared, n_shared = template(cur["lines"], [x[2] for x in near])
            text = main_text(cur["lines"], shared)
            return {"page_id": cur["page_id"], "url": cur["url"], "text": text, "n_chars": len(text), "n_shared": n_shared}

        out, window, here = [], [], 0  # window[here] is the next page to be finished
        for nxt in chain(rows(), repeat(None, REACH)):
            if nxt is not None:
                window.append(nxt)
            if len(window) - here > REACH or nxt is None and here < len(window):
                cur = window[here]
                if not cur["guest"]:
                    out.append(finish(window[max(0, here - REACH) : here], cur, window[here + 1 : here + 1 + REACH]))
                here += 1
            if here > REACH:
                window.pop(0)
                here -= 1
            if len(out) >= 100:
                yield pa.RecordBatch.from_pylist(out, schema=result)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=result)

    spread = d.select("host", "path", "key", "page_id", "url", "html").mapInArrow(route, "block int, guest boolean, host string, path string, key string, page_id long, url string, lines array<string>, marks array<tinyint>")
    ordered = spread.repartition("block").sortWithinPartitions("block", "key", "guest")
    return ordered.mapInArrow(difference, "page_id long, url string, text string, n_chars long, n_shared long")


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n
