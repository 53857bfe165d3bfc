"""Main text of web pages by nearest-URL page differencing.

A page is cut into blocks (lines of text between block-level tags). Every page is compared
with its nearest: the pages of a host stand in order of URL path, each is paired with the
neighbours on either side, and their lines are aligned by longest common subsequence. The
nearest is the one whose path has the longest prefix in common with the page's own.

Lines shared with the nearest page are deleted; the page's markup has a vote. Blocks inside
elements that say plainly what they are (menus, headers, footers, sidebars, notices, adverts,
forms to fill in, reader comments, by tag, role or whole class name) go in any case. A name that
only begins or ends like those ("ad-story", "related-work"), or that parts of an article have, too
("related", "notice"; unless most of the part is links), leaves the decision to differencing. A
form around a page is none, and inline parts of an article have no names that count.
Blocks inside ``article`` or ``main`` are the text and stay, but for lines that the pages on
both sides share while being other texts. A page whose unshared text outside is over twice
that inside has marked a teaser only, and is judged as if it had marked nothing.

The order over all pages is a distributed sort of small rows (path and line hashes), so a
host with a third of all pages is split over many tasks; a page finds its neighbours by
position. Only the numbers of deleted lines come back to the pages.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, small, written
from .url_filter import split_url

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*>"
#: Elements whose content is no text of the page. Only a self-closed svg has none.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template iframe textarea title svg".split()}
_SVG = re.compile(rf"<(/?)svg(?=[\s/>]){_ATTRS}", re.I)
#: What ends an svg that is never closed.
_BREAKOUT = re.compile(r"</?(?:article|aside|blockquote|body|center|dd|div|dl|dt|em|footer|form|h[1-6]|header|hr|img|li|main|nav|ol|p|pre|section|span|strong|table|ul)(?=[\s/>])", re.I)
#: What may stand in a head; anything else ends it, closed or not.
_IN_HEAD = re.compile(rf"\s+|<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|noscript|template|title)(?=[\s/>]){_ATTRS}.*?(?:</\1\s*>|\Z)|</?(?:meta|link|base|basefont|bgsound|html)(?=[\s/>]){_ATTRS}|</(?!(?:head|body)[\s>])[a-z]{_ATTRS}", re.S | re.I)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source audio video track map area object math mi mn mo ms mspace mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text, by tag; header is one unless it stands in the article.
_FURNITURE = frozenset("nav footer aside form menu dialog button select option input fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup comment comments commentlist disqus reply replies respond related share sharing social widget".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_PART = re.compile(r"[a-z]+", re.I)
#: Parts of class names that say nothing about the content.
_PLAIN = frozenset("area bar block body bottom box btn button buttons col column container content div element footer group head header holder icon icons inner item items left link links list main module outer panel post posts region right row section slot slots space static text title top unit view wrap wrapper".split())


#: Names that parts of an article have, too: there they count only where most of the part is links.
_ALSO_TEXT = frozenset("related alert notice notices banner header masthead menu footer promotion reply".split())
_FORM_END = re.compile(r"</?form(?=[\s/>])", re.I)
_FIELD = re.compile(r"<(?:button|select|textarea|input(?![^>]*\btype\s*=\s*[\"']?hidden))(?=[\s/>])", re.I)
_HOLDS_TEXT = re.compile(r"<(?:article|main)(?=[\s/>])|role\s*=\s*[\"']?main", re.I)
_MARKUP = re.compile(r"<(script|style)(?=[\s>]).*?</\1\s*>|<[^>]*>", re.S | re.I)
_LINK = re.compile(r"<a(?=[\s>])[^>]*>(.*?)</a\s*>", re.S | re.I)
#: Characters of text a field that tell a form around a page from one to fill in, and of a part that is looked at for links.
_PER_FIELD, _PART_SIZE = 300, 20_000


def _wraps_page(page: str, at: int) -> bool:
    """Whether the form that opens before ``at`` holds an article, or little but fields: text of a page."""
    end = _FORM_END.search(page, at)
    inner = page[at : end.start() if end else len(page)]
    return bool(_HOLDS_TEXT.search(inner)) or len(_MARKUP.sub("", inner).split()) * 6 >= _PER_FIELD * max(1, len(_FIELD.findall(inner)))


def _mostly_links(page: str, tag: str, at: int) -> bool:
    """Whether half of the text of the part that opens before ``at`` is in links."""
    inner = page[at : at + _PART_SIZE]
    end = re.search(rf"</{re.escape(tag)}(?=[\s>])", inner, re.I)
    inner = inner[: end.start()] if end else inner
    size = lambda x: sum(map(len, _MARKUP.sub(" ", x).split()))
    return 2 * sum(size(x) for x in _LINK.findall(inner)) >= size(inner)


def _is_furniture(tag: str, attributes: str, in_main: bool, page: str, at: int) -> int:
    """2 where an element says that it is no main text, 1 where its name only hints at it. Inline
    parts of an article are its text, whatever their names."""
    if in_main and tag in _INLINE:
        return 0
    if tag == "form" and _wraps_page(page, at):
        return 0
    if tag in _FURNITURE or (tag == "header" and not in_main):
        return 2
    if tag in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return 0
    found = 0
    for m in _ATTR.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in _ROLES:
                return 2
            continue
        for name in value.split():
            parts = _PART.findall(name)
            if name in _NAMES or (parts and not (in_main and parts[-1] in ("header", "title")) and any(x in _NAMES for x in parts) and all(x in _NAMES or x in _PLAIN for x in parts)):
                if not (in_main and _ALSO_TEXT.issuperset(x for x in parts if x in _NAMES)) or _mostly_links(page, tag, at):
                    return 2
                found = 1
            if parts and (parts[-1] in _NAMES or parts[0] in _NAMES) and not (in_main and parts[-1] in ("header", "title")):
                found = 1
    return found


def _after_raw(page: str, tag: str, at: int) -> int:
    """Where the content of a raw element that opens before ``at`` ends, its closing tag included."""
    if tag == "head":
        while m := _IN_HEAD.match(page, at):
            at = m.end()
        return at
    if tag == "svg":
        depth = 1
        for m in _SVG.finditer(page, at):
            depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
            if not depth:
                return m.end()
    end = _RAW[tag].search(page, at)
    if end is None and tag == "svg":
        end = _BREAKOUT.search(page, at)
        return end.start() if end else len(page)
    return end.end() if end else len(page)


def blocks_of(page: str | None) -> list[tuple[str, bool]]:
    """(text, whether it stands in an article or main element) of a page's blocks in order,
    without those of furniture. White space is one space; empty blocks are left out."""
    return [(text, main) for text, main, _ in parsed(page)]


def parsed(page: str | None) -> list[tuple[str, bool, bool]]:
    """Blocks as above, and whether a name hints that they are furniture. Time is linear in
    the page, however deep its elements are."""
    out: list[tuple[str, bool, bool]] = []
    if not page:
        return out
    stack: list[tuple[str, int, bool]] = []  # tag, furniture, main
    opened: dict[str, list[int]] = {}  # places of each tag in the stack
    solid: list[int] = []  # places of block-level elements
    buffer: list[str] = []
    skip, main, hinted = False, False, False

    def flush() -> None:
        if buffer:
            text = " ".join(html_lib.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, main, hinted))

    def close(to: int) -> bool:
        """Drop the stack down to ``to``; whether a block-level element was among it."""
        for tag, _, _ in reversed(stack[to:]):
            opened[tag].pop()
        del stack[to:]
        before = len(solid)
        while solid and solid[-1] >= to:
            solid.pop()
        return len(solid) < before

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if not skip and (text[0] != "<" or text == "<"):
                buffer.append(text)
            continue
        tag = tag.lower()
        if tag == "br":
            buffer.append(" ")
            continue
        if not m[1] and (tag in _RAW or tag == "head"):
            if tag != "svg" or not m[3].endswith("/"):
                at = _after_raw(page, tag, at)
            if not skip:
                buffer.append(" ")
            continue
        plain = tag in _INLINE
        if not plain:
            flush()
        if m[1]:
            if opened.get(tag):
                top = opened[tag][-1]
                if solid and solid[-1] >= top:
                    flush()
                close(top)
        else:
            if tag in _CLOSES_P and solid and stack[solid[-1]][0] == "p":
                close(solid[-1])
            if tag in _SELF_CLOSING:
                while stack and (stack[-1][0] in _SELF_CLOSING[tag] or stack[-1][0] in _INLINE or stack[-1][0] == "p") and any(x[0] in _SELF_CLOSING[tag] for x in stack[-4:]):
                    close(len(stack) - 1)
            above = stack[-1] if stack else ("", 0, False)
            if tag in _VOID:  # a slash closes no other element of HTML
                continue
            furniture = above[1] if above[1] == 2 else max(above[1], _is_furniture(tag, m[3], above[2], page, at))
            opened.setdefault(tag, []).append(len(stack))
            if not plain:
                solid.append(len(stack))
            stack.append((tag, furniture, above[2] or (furniture < 2 and (tag in ("article", "main") or 'role="main"' in m[3]))))
        skip, main, hinted = (stack[-1][1] == 2, stack[-1][2], stack[-1][1] == 1) if stack else (False, False, False)
    flush()
    return out


def chosen(blocks: list[tuple[str, bool, bool]], sides: list[tuple[int, list[int]]]) -> list[str]:
    """The texts of a page's blocks that are its main text. ``sides``: for each neighbour, the
    length of the common path and the numbers of the shared lines."""
    shared = [set(gone) for _, gone in sides]
    nearest = set(max(sides, key=lambda x: (x[0], len(x[1]), x[1]))[1]) if sides else set()
    size = lambda inside: sum(len(t) for i, (t, main, hint) in enumerate(blocks) if main == inside and (inside or not (hint or i in nearest)))
    if not any(main for _, main, _ in blocks) or size(False) > 2 * size(True):
        return [t for i, (t, _, _) in enumerate(blocks) if i not in nearest]
    other_texts = len(shared) == 2 and all(2 * len(x) <= len(blocks) for x in shared)
    both = shared[0] & shared[1] if other_texts else set()
    return [t for i, (t, main, hint) in enumerate(blocks) if main and i not in both and not (hint and i in nearest)]


def shared_lines(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Matches are threaded into a longest chain that ascends in both: for each line of a its
    places in b, last first, extend the shortest chain they can; r matches cost r log r."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k] = j
                links[k] = link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def deletions(pages: DataFrame) -> DataFrame:
    """(key, sides): for each page its neighbours, by the length of the common path and the
    numbers of the lines they share (array<struct<near,gone>>, at most two). A neighbour that
    shares no line counts, too, one that shares all does not. ``pages``: key, host, path, lines
    (array of hashes)."""
    ordered = pages.orderBy("host", "path", "key")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, run, last = TaskContext.get().partitionId(), 0, -1, None
        for batch in batches:
            n, runs = batch.num_rows, []
            for own in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                run, last = run + (own != last), own
                runs.append(run)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array(runs, pa.int64()), *batch.columns], names=["part", "pos", "run", *batch.schema.names])
            at += n

    rows = written(ordered.mapInArrow(number, "part int, pos long, run long, key long, host string, path string, lines array<long>"), "page-order")
    # runs of copies count through all parts; one that goes on into the next part stays one
    place, copy = F.struct("part", "pos"), F.xxhash64("host", "lines")
    in_order = Window.orderBy("part")
    parts = rows.groupBy("part").agg(F.max("run").alias("runs"), F.min_by(copy, "pos").alias("first"), F.max_by(copy, "pos").alias("last"))
    parts = parts.withColumn("goes_on", F.coalesce(F.col("first") == F.lag("last").over(in_order), F.lit(False)).cast("long"))
    base = parts.select("part", (F.sum(F.col("runs") + 1 - F.col("goes_on")).over(in_order) - F.col("runs") - 1).alias("base"))
    rows = rows.join(F.broadcast(base), "part").withColumn("run", F.col("run") + F.col("base"))
    page = F.struct("host", "path", "key", "lines")
    ends = rows.groupBy("run").agg(F.min_by(page, place).alias("first"), F.max_by(page, place).alias("last"))
    near = ends.select((F.col("run") + 1).alias("run"), F.col("last").alias("n")).unionByName(ends.select((F.col("run") - 1).alias("run"), F.col("first").alias("n")))
    near = near.select("run", F.col("n.host").alias("n_host"), F.col("n.path").alias("n_path"), F.col("n.lines").alias("n_lines"))
    both = rows.where("size(lines) > 0").join(near, "run").where("host = n_host")

    def align(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, gone, far = [], [], []
        for r in batch.to_pylist():
            lost = shared_lines(r["lines"], r["n_lines"])
            if len(lost) == len(r["lines"]):  # it tells nothing
                continue
            key.append(r["key"])
            gone.append(lost)
            far.append(_common_prefix(r["path"], r["n_path"]))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(far, pa.int32()), pa.array(gone, pa.list_(pa.int32()))], names=["key", "near", "gone"])

    cut = map_arrow(both.select("key", "path", "lines", "n_path", "n_lines"), align, "key long, near int, gone array<int>")
    # a page has one neighbour on either side
    return cut.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("near", "gone"))).alias("sides"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text (blocks joined by an empty line), n_chars.

    Null and empty html give an empty text. A page's neighbours are the next pages with other
    lines than its own, past any copies; one that shares every line counts for nothing. Pages
    without ``://`` in their url form a host of their own. Repeated rows each get the text, and
    rows of one id are pages of their own. Whole pages count, however long or deep. Other
    columns are ignored, whatever their names. An empty table gives no rows. Pages are told
    apart by a 64-bit hash of url and html.
    """
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.xxhash64(F.col(url), F.col(html)).alias("key"))
    kind = src.schema["page_id"].dataType.simpleString()

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        split = [split_url(u) for u in batch.column(1).to_pylist()]
        hashes = [[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in blocks_of(h)] for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(3), pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string()), pa.array(hashes, pa.list_(pa.int64()))], names=["key", "host", "path", "lines"])

    slim = written(map_arrow(src, lines, "key long, host string, path string, lines array<long>").dropDuplicates(["key"]), "page-lines")
    # most pages share no line with either neighbour, and need none told
    told = written(deletions(slim).where(F.exists("sides", lambda x: F.size(x["gone"]) > 0)), "page-sides")
    joined = src.join(small(told), "key", "left").select("page_id", "url", "html", "sides")

    def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = ["\n\n".join(chosen(parsed(page), [(x["near"], x["gone"]) for x in sides or ()])) for page, sides in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(joined, texts, f"page_id {kind}, url string, text string, n_chars long")
