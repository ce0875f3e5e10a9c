"""Main text of web pages by template deduction from equivalence classes of tokens.

A page's tokens are its tags (name, class and id) and its runs of text, told apart by the path of open tags they occur under. Over the
pages of a host, two tokens are in one equivalence class when they occur equally often in every page: the vector of a token is kept
as its number of pages and the exclusive-or of a hash of (page, count), which combines map-side, so a host with a third of all pages
moves no more rows than others. Classes of tokens that occur in SUPPORT of the host's pages, MIN_CLASS tokens at least, are
large and frequent: they make up the host's template. In a page a class is valid if its tokens come in the same order in each of its repetitions and
do not overlap another class without being nested in it; valid classes are nested, and what lies between their tokens are the slots. Vectors are over the
distinct page contents of a host, so that copies of a page are one page there; a class that holds most of a page's text is no template of that page.

The article is what the template's <article> or <main> tags enclose (of several alike, all; else the one with most text), unless they are a teaser beside far more paragraph text; without these, the element whose slots
hold most text outside links, with the elements around it that have paragraphs of their own. Inside it, blocks all of whose text the template fixes are left out; removed are also the parts that are not article by their element (menus, headers and footers of the page, sidebars,
forms, scripts, styles, ...) or by the names in their class, id or role (adverts, cookie notices, comments, ...); a form or a name removes nothing that holds most of the
page's paragraph text.

Blocks: text between block-level tags, references decoded, white space made one blank, trimmed, joined by line feeds.

Defined cases: a null or empty page has the text "" and 0 characters. A host with fewer than MIN_PAGES pages has no template and is read by its elements
alone. Repeated pages are kept; the template counts each content once. Pages with a null or odd url form one host by what stands before the first slash. Unclosed
elements end with their parent. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilake.llm import text as T
from equilake.session import store

SUPPORT = 0.5
MIN_PAGES = 4
MIN_CLASS = 2
MOST_BROADCAST = 500_000

# HTML elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe object svg math canvas select option".split())
CHROME = set("nav header footer aside form button dialog menu fieldset figcaption".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|side|menu|navbar|nav|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|reply|replies|disqus|related|recommend\w*|share|sharing|social|widget|pagination|pager|toolbar|login|signup|search)(?:$|[\s_-])", re.I)
_CLOSED_BY = {"p": BLOCKS - {"html", "body", "head"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_BLANK = re.compile(r"\s+")


class Token:
    """A tag or a run of text of a page: kind 'open', 'close' or 'text', its name or text, attributes, and path key."""

    __slots__ = ("kind", "name", "names", "key", "depth")

    def __init__(self, kind: str, name: str, names: str, key: int, depth: int):
        self.kind, self.name, self.names, self.key, self.depth = kind, name, names, key, depth


def tokens(page: str) -> list[Token]:
    """The tokens of a page, with elements that need no end tag closed; contents of raw elements are left out."""
    out: list[Token] = []
    stack: list[tuple[str, int]] = [("", 0)]

    def close(n: int) -> None:
        while len(stack) > n:
            name, key = stack.pop()
            out.append(Token("close", name, "", key ^ 1, len(stack)))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            run = page[at:stop]
            if not run.isspace():
                out.append(Token("text", run, "", xxhash.xxh64_intdigest(run, stack[-1][1] & 0xFFFFFFFF), len(stack)))
            elif out and out[-1].kind == "text":
                out.append(Token("text", " ", "", 0, len(stack)))
        if not m:
            break
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                run = m.group()[9:].removesuffix("]]>")
                out.append(Token("text", html.escape(run, quote=False), "", xxhash.xxh64_intdigest(run, stack[-1][1] & 0xFFFFFFFF), len(stack)))
            continue
        if m.group(1):
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if depth:
                close(depth)
            continue
        for k in range(len(stack) - 1, 0, -1):
            if name in _CLOSED_BY.get(stack[k][0], ()):
                close(k)
                break
            if stack[k][0] in ("table", "ul", "ol", "div", "article", "section", "main", "dl", "blockquote", "nav", "body"):
                break
        names = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(m.group(3))) if m.group(3) else ""
        key = xxhash.xxh64_intdigest(f"{name} {names}", stack[-1][1] & 0xFFFFFFFF) & ~1
        out.append(Token("open", name, names, key, len(stack)))
        if name in ("svg", "math") and _CLOSED.search(m.group(3)):
            # Elements of XML may close themselves.
            out.append(Token("close", name, "", key ^ 1, len(stack)))
        elif name in RAW:
            done = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = done.end() if done else end
            out.append(Token("close", name, "", key ^ 1, len(stack)))
        elif name not in VOID and not _CLOSED.search(m.group(3)):
            stack.append((name, key))
    close(1)
    return out


# -- template of a host ---------------------------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, page mark, count, place) for the distinct tokens of each page; the mark stands for the page in its vector."""
    for batch in batches:
        hosts, keys, counts, marks, places = [], [], [], [], []
        for host, page_id, page in zip(batch.column("host").to_pylist(), batch.column("mark").to_pylist(), batch.column("html").to_pylist(), strict=True):
            number: dict[int, int] = defaultdict(int)
            first: dict[int, int] = {}
            for k, t in enumerate(tokens(page or "")):
                if t.key:
                    number[t.key] += 1
                    first.setdefault(t.key, k)
            hosts += [host] * len(number)
            keys += number
            counts += number.values()
            marks += [page_id] * len(number)
            places += first.values()
        vector = T.mix(np.array(marks, dtype=np.int64).view(np.uint64) ^ T.mix(np.array(counts, dtype=np.uint64))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(vector), pa.array(places, pa.int64())], names=["host", "token", "vector", "place"])


def distinct_pages(pages: DataFrame) -> DataFrame:
    """pages (host, mark, html) with one row for each mark of a host. Only contents that occur twice or more are shuffled."""
    copies = store(pages.groupBy("host", "mark").agg(F.count("*").alias("n")).where("n > 1").select("host", "mark"), "page_copies")
    n = copies.count()
    if not n:
        return pages
    if n <= MOST_BROADCAST:
        copies = F.broadcast(copies)
    once = pages.join(copies, ["host", "mark"], "left_semi").dropDuplicates(["host", "mark"])
    return pages.join(copies, ["host", "mark"], "left_anti").unionByName(once)


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, template): the tokens of each host's large and frequent classes as (token, class), in the order of their mean place.

    pages: host, mark (a number for each content), html; copies count once. A host's template is no larger than two of its pages (at support 0.5).
    """
    pages = distinct_pages(pages.select("host", "mark", "html"))
    seen = pages.mapInArrow(_count, "host string, token bigint, vector bigint, place bigint")
    found = seen.groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), F.count("*").alias("n"), F.avg("place").alias("place"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages")).where(f"pages >= {MIN_PAGES}")
    frequent = store(found.join(sizes, "host").where(F.col("n") >= support * F.col("pages")), "page_tokens")
    classes = frequent.groupBy("host", "vector", "n").agg(F.count("*").alias("size"), F.min("place").alias("first")).where(f"size >= {MIN_CLASS}")
    kept = frequent.join(classes, ["host", "vector", "n"])
    return kept.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "token", F.xxhash64("vector", "n").alias("class")))).alias("template"))


def valid_classes(page: list[Token], classes: dict[int, int]) -> dict[int, list[int]]:
    """The classes that are ordered and nested in a page, with the places of their tokens."""
    places: dict[int, list[int]] = defaultdict(list)
    for k, t in enumerate(page):
        if t.key in classes:
            places[classes[t.key]].append(k)
    out: dict[int, list[int]] = {}
    for c, at in places.items():
        order = list(dict.fromkeys(page[k].key for k in at))
        if len(at) % len(order) == 0 and all(page[k].key == order[j % len(order)] for j, k in enumerate(at)):
            out[c] = at
    # Nested: each repetition of one of two classes lies between two neighbouring tokens of the other. Larger classes come first.
    kept: dict[int, np.ndarray] = {}
    for c in sorted(out, key=lambda c: (-len(out[c]), out[c][0])):
        at = np.array(out[c]).reshape(-1, len({page[k].key for k in out[c]}))
        if all(_within(at, other) or _within(other, at) for other in kept.values()):
            kept[c] = at
    return {c: out[c] for c in out if c in kept}


def _within(inner: np.ndarray, outer: np.ndarray) -> bool:
    """Each row of inner (a repetition) lies in one gap between the tokens of outer."""
    gap = np.searchsorted(outer.ravel(), inner)
    return bool((gap == gap[:, :1]).all())


# -- text of a page -------------------------------------------------------------------------------------------------------

def _clean(parts: list[str]) -> str:
    return _BLANK.sub(" ", html.unescape("".join(parts))).strip()


def main_text(page: str | None, template: dict[int, int] | None = None) -> str:
    """The main text of one page. template: the class of each token of its host's template."""
    if not page:
        return ""
    run = tokens(page)
    valid = valid_classes(run, template) if template else {}
    weight = _weights(run)
    fixed = {k for at in valid.values() if 2 * sum(weight[k] for k in at) <= sum(weight) for k in at}
    paragraphs = _paragraphs(run)
    slots, inside = _slots(run, fixed, paragraphs)
    return "\n".join(block for begin, end in slots for block in _blocks(run, begin, end, inside, fixed, paragraphs))


def _blocks(run: list[Token], begin: int, end: int, inside: bool, fixed: set[int], paragraphs: list[int]) -> list[str]:
    """The blocks of a slot; those that the template fixes as a whole are left out."""
    blocks, parts, skip, own = [], [], 0, False
    for k in range(begin, end):
        t = run[k]
        if t.kind == "text":
            if not skip:
                parts.append(t.name)
                own |= k not in fixed
            continue
        if t.name in BLOCKS:
            if own and (block := _clean(parts)):
                blocks.append(block)
            parts, own = [], False
        elif t.name == "br":
            parts.append(" ")
        if skip:
            skip += t.kind == "open" and t.name not in VOID
            skip -= t.kind == "close"
        elif t.kind == "open" and t.name not in VOID and (t.name in RAW or _chrome(run, k, inside, paragraphs)):
            skip = 1
    if own and (block := _clean(parts)):
        blocks.append(block)
    return blocks


def _weights(run: list[Token]) -> list[int]:
    """Characters of each run of text outside links and menus, headers and footers."""
    out, stack = [], []
    for t in run:
        while stack and stack[-1] >= t.depth:
            stack.pop()
        if t.kind == "open" and (t.name == "a" or t.name in CHROME and t.name != "form"):
            stack.append(t.depth)
        out.append(len(t.name.strip()) if t.kind == "text" and not stack else 0)
    return out


def _paragraphs(run: list[Token]) -> list[int]:
    """Characters of paragraph text outside links before each token, and in all."""
    out, total, stack = [], 0, []
    for t in run:
        out.append(total)
        while stack and stack[-1][0] >= t.depth:
            stack.pop()
        if t.kind == "open" and t.name in ("p", "pre", "blockquote", "a"):
            stack.append((t.depth, t.name == "a"))
        elif t.kind == "text" and stack and not any(link for _, link in stack):
            total += len(t.name.strip())
    return [*out, total]


def _chrome(run: list[Token], k: int, inside: bool, paragraphs: list[int]) -> bool:
    t = run[k]
    if t.name in ("header", "figcaption") and inside:
        return False
    if t.name in CHROME and t.name != "form":
        return True
    if t.name != "form" and not (t.names and NOISE.search(t.names)):
        return False
    return 2 * (paragraphs[_end(run, k)] - paragraphs[k]) <= paragraphs[-1]


def _slots(run: list[Token], fixed: set[int], paragraphs: list[int]) -> tuple[list[tuple[int, int]], bool]:
    """(first, last) of the tokens that hold the article, in order, and whether they are article elements."""
    heads = [k for k, t in enumerate(run) if t.kind == "open" and t.name in ("article", "main")]
    if heads:
        # The template's own element before one that only this page has; of several the one with most text, and those under the same path and names.
        known = [k for k in heads if k in fixed] or heads
        spans = [(k, _end(run, k)) for k in known]
        held = {k: sum(len(t.name) for t in run[k:e] if t.kind == "text") for k, e in spans}
        begin, _ = max(spans, key=lambda s: (held[s[0]], -s[0]))
        alike = [(k + 1, e) for k, e in spans if run[k].key == run[begin].key and run[k].depth == run[begin].depth]
        # A teaser: an element outside holds far more paragraph text than all of them.
        inside = sum(held[k - 1] for k, _ in alike)
        if paragraphs[-1] - sum(paragraphs[e] - paragraphs[k] for k, e in alike) > 2 * inside:
            best, end = _heaviest(run, fixed, paragraphs)
            if paragraphs[end] - paragraphs[best] > 2 * inside:
                return [(best, end)], False
        return alike, True
    return [_heaviest(run, fixed, paragraphs)], False


def _heaviest(run: list[Token], fixed: set[int], paragraphs: list[int]) -> tuple[int, int]:
    """(first, last) of the tokens inside the outermost element that is mostly text around the one with most text.

    Text in paragraphs counts for the element around them, text in links against it.
    """
    mass: dict[int, int] = defaultdict(int)
    above: dict[int, list[int]] = {}
    flow = [0] * (len(run) + 1)
    stack, skip, link = [-1], 0, 0
    for k, t in enumerate(run):
        flow[k + 1] = flow[k]
        if t.kind == "open" and t.name not in VOID:
            skip += bool(skip) or t.name in RAW or _chrome(run, k, False, paragraphs)
            link += t.name == "a"
            stack.append(k)
        elif t.kind == "close" and len(stack) > 1:
            skip -= bool(skip)
            link -= t.name == "a"
            stack.pop()
        elif t.kind == "text" and not skip and k not in fixed and len(t.name.strip()) > 1:
            block = next((i for i in range(len(stack) - 1, 0, -1) if run[stack[i]].name in BLOCKS), 0)
            place = max(block - 1, 0) if run[stack[block]].name in ("p", "pre", "blockquote", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6") else block
            size = -len(t.name) if link else len(t.name)
            mass[stack[place]] += size
            above.setdefault(stack[place], stack[:place])
            flow[k + 1] += size
    best = max(mass, key=lambda k: (mass[k], -k), default=-1)
    if best < 0:
        return 0, len(run)
    # An element around it that has paragraphs of its own belongs to the article, unless links outweigh what it adds.
    chosen = best
    for k in reversed(above[best][1:]):
        if mass[k] > 0 and flow[_end(run, k)] - flow[k] > flow[_end(run, chosen)] - flow[chosen]:
            chosen = k
    return chosen + 1, _end(run, chosen)


def _end(run: list[Token], k: int) -> int:
    """The place of the end tag of the element opened at k."""
    return next((j for j in range(k + 1, len(run)) if run[j].kind == "close" and run[j].depth == run[k].depth), len(run))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict[int, int]] = {}
    for batch in batches:
        found = []
        hosts, lists = batch.column("host").to_pylist(), batch.column("template")
        for i, (host, page) in enumerate(zip(hosts, batch.column("html").to_pylist(), strict=True)):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = {r["token"] & 0xFFFFFFFFFFFFFFFF: r["class"] for r in lists[i].as_py() or []}
            found.append(main_text(page, known[host]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in ("host", "html", "template")), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                                         names=[*(c for c in batch.schema.names if c not in ("host", "html", "template")), "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)", 1))
    rows = rows.withColumn("host", host)
    made = store(templates(rows.withColumn("mark", F.xxhash64("html"))), "templates")
    if (made.select(F.sum(F.size("template"))).first()[0] or 0) <= MOST_BROADCAST:
        made = F.broadcast(made)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.join(made, "host", "left").select("page_id", "url", "host", "html", "template").mapInArrow(_extract, f"{fields}, text string, n_chars bigint")
