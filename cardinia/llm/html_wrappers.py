"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of blocks, each a text with the path of the block elements around it.
A wrapper is a sequence of items, each a group of paths that may be optional (``?``) or
repeated (``+``), with a text slot for every path. It starts as the first page of a host
and is aligned with one page after another:

* paths that agree are one slot; where its texts differ, the slot is variable;
* repeated runs of paths, on a page or in the wrapper, fold into a repeated group;
* what only one side has becomes an optional group.

Wrappers of one host align with each other just as pages do, so each task infers its
own, and these meet in two steps (by host and salt, then by host): no task sees all
pages of a host with a third of the table. A wrapper then says where the article is: in
the lowest element that holds all variable slots, or in ``article`` or ``main`` elements
inside it, unless the variable slots show that these are only teasers. Menus, forms,
adverts, comments and the like are no part of it. Within it nothing is dropped, be it the
same on all pages or not.
"""

from __future__ import annotations

import html as html_lib
import os.path
import pickle
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinia.llm import skew
from cardinia.llm._util import lean, scope, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|noscript|template|iframe|svg|math)\b(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*+)>"
    r"|<[!?][^>]*>"
    r"|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_BLOCKS = frozenset(
    "html head body main article section aside header footer nav div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption form fieldset legend address details summary dialog menu button select option optgroup label center hr".split()
)
_VOID = frozenset(("hr",))
#: An opening tag ends these open elements, if they stand innermost.
_ENDS = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",), "body": ("head",)}
_NEVER = frozenset("nav footer aside form button select option optgroup label menu dialog head fieldset".split())
#: Parts of class names, ids and roles that mark what is not the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adslot adbox adunit adbanner adsense sponsor sponsored promo promotion banner"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar rail widget widgets toolbar topbar pagination pager footer masthead copyright"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall disclaimer share sharing social related recommended"
    " comment comments commentlist respond reply replies discussion disqus".split()
)
#: Inside the article a name marks only as a whole: a mark, or marks joined with these parts alone.
_JOINED = frozenset(
    "list area box block bar button buttons link links icon icons item items container wrapper wrap thread form slot unit post posts article articles"
    " story stories entry page site js wp widget top bottom inline".split()
)
_JOINED_NAMES = frozenset((("comment", "section"), ("comments", "section"), ("disqus", "thread"), ("related", "content"), ("recommended", "content")))
#: Ids of the first are anchors; inside the article, ids of the second alone count, and only if they join parts.
_ANCHORED, _HOLDING = frozenset("h1 h2 h3 h4 h5 h6 p".split()), frozenset("div ul ol dl table".split())
#: What the path has of an element inside the article whose names say that it is not the article's.
_FOREIGN = "!"
#: A header by its marks, unless these say that it is the article's own.
_HEADER, _OWN = "header", frozenset("article post entry story content".split())
#: Class names that speak of something else on the page, as in "no-sidebar".
_ABOUT = re.compile(r"(?:no|without|has|with|is)[-_]", re.I)
#: Article elements with less than this share of a host's variable text are teasers.
_TEASERS = 0.25
#: Items of a wrapper beyond which runs of optional ones are taken together.
_ITEMS = 4096
#: Longest group that repeats.
_PERIOD = 6
#: Bytes of the hosts' regions up to which they are sent to every task; beyond, pages are joined with them.
SENT = 32 << 20
VARIABLE = -1


def _marks(name: str, attributes: str, inside: bool) -> str:
    """The element's marks as its path has them: letter parts of its names, and _FOREIGN."""
    found: set[str] = set()
    for kind, *values in _NAMES.findall(attributes):
        kind = kind.lower()
        if kind == "id" and name in _ANCHORED:
            continue
        for c in "".join(values).lower().split():
            if _ABOUT.match(c):
                continue
            parts = _PART.findall(c)
            found.update(parts)
            if inside and (kind != "id" or (name in _HOLDING and len(parts) > 1)):
                whole = not _MARKS.isdisjoint(parts) and all(w in _MARKS or w in _JOINED for w in parts)
                if whole or tuple(parts) in _JOINED_NAMES:
                    found.add(_FOREIGN)
    return "." + ".".join(sorted(found)) if found else ""


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(path, text) of every block with text, in page order; paths are elements with their marks, '/' between."""
    page = page or ""
    out: list[tuple[str, str]] = []
    stack: list[str] = []
    paths = [""]
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((paths[-1], text))

    def push(name: str, marks: str) -> None:
        stack.append(name)
        paths.append(f"{paths[-1]}/{name}{marks}")

    def pop() -> str:
        paths.pop()
        return stack.pop()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
        if name not in _BLOCKS:
            continue
        flush()
        if m[2]:
            if name in stack:
                while pop() != name:
                    pass
        else:
            for _ in range(3):
                if stack and stack[-1] in _ENDS.get(name, ("p",)):
                    pop()
            if name in _VOID:
                continue
            marks = _marks(name, m[4], "article" in stack or "main" in stack) if m[4] else ""
            push(name, marks)
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def excluded(path: str) -> bool:
    """Whether an element around the block says that it is not the article's."""
    inside = False
    for element in path.split("/")[1:]:
        name, *marks = element.split(".")
        if name in _NEVER or (name == "header" and not inside):
            return True
        if inside:
            if _FOREIGN in marks:
                return True
        elif name not in ("html", "body", "main", "article"):
            if not _MARKS.isdisjoint(marks) or (_HEADER in marks and _OWN.isdisjoint(marks)):
                return True
        inside = inside or name in ("article", "main")
    return False


# An item: [paths, repeated, optional, pages, [[characters, text's crc or VARIABLE], ... one for each path]].
# A wrapper: (pages, items).
Wrapper = tuple[int, list[list]]


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def _join(a: list, b: list, same_page: bool) -> list:
    """Two items of the same paths as one."""
    slots = [[x[0] + y[0], x[1] if x[1] == y[1] and not same_page else VARIABLE] for x, y in zip(a[4], b[4], strict=True)]
    return [a[0], a[1] or b[1] or same_page, (a[2] and b[2]) if same_page else (a[2] or b[2]), max(a[3], b[3]) if same_page else a[3] + b[3], slots]


def folded(items: list[list]) -> list[list]:
    """Runs that repeat at once, with a period of up to _PERIOD paths, as one repeated group."""
    for period in range(1, _PERIOD + 1):
        if len(items) < 2 * period:
            break
        out: list[list] = []
        i = 0
        while i < len(items):
            block = items[i : i + period]
            keys = [x[0] for x in block]
            j = i + period
            group = None
            while len(block) == period and j + period <= len(items) and [x[0] for x in items[j : j + period]] == keys:
                group = group or [tuple(p for x in block for p in x[0]), True, any(x[2] for x in block), max(x[3] for x in block), [s for x in block for s in x[4]]]
                more = items[j : j + period]
                group = _join(group, [group[0], True, any(x[2] for x in more), max(x[3] for x in more), [s for x in more for s in x[4]]], True)
                j += period
            if group is None:
                out.append(items[i])
                i += 1
            else:
                out.append(group)
                i = j
        items = out
    return items


def page_wrapper(page: str | None) -> Wrapper:
    return 1, folded([[(path,), False, False, 1, [[len(text), _crc(text)]]] for path, text in blocks(page)])


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of ``pairs`` (first numbers rise) in which the second numbers rise, too."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before[k] = last[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[at], last[at] = j, k
    out = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a common subsequence of the items' paths, in memory that grows with their number only.

    What both begin and end with agrees; between, paths that each has once are matched in
    rising order, and so is again what stands between these; where no path is unique,
    their first occurrences are matched with each other, their second ones, and so on.
    """
    numbers: dict = {}
    x, y = ([numbers.setdefault(i[0], len(numbers)) for i in items] for items in (a, b))
    out: list[tuple[int, int]] = []
    waiting = [(0, len(x), 0, len(y))]
    while waiting:
        i, m, j, n = waiting.pop()
        while i < m and j < n and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and x[m - 1] == y[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        there: dict[int, list[int]] = {}
        for q in range(j, n):
            there.setdefault(y[q], []).append(q)
        here: dict[int, list[int]] = {}
        for p in range(i, m):
            if x[p] in there:
                here.setdefault(x[p], []).append(p)
        single = sorted((p[0], there[k][0]) for k, p in here.items() if len(p) == len(there[k]) == 1)
        if single:
            for p, q in [*_rising(single), (m, n)]:
                waiting.append((i, p, j, q))
                if p < m:
                    out.append((p, q))
                i, j = p + 1, q + 1
        else:
            out += _rising(sorted(z for k, p in here.items() for z in zip(p, there[k], strict=False)))
    return sorted(out)


def bounded(items: list[list], most: int = _ITEMS) -> list[list]:
    """The items, optional ones taken together where they are many: first those of one parent, then those of one grandparent, and so on.

    Nothing is lost but where in that element its text stands: their characters add up, as variable ones.
    """
    if len(items) > most:  # what is excluded decides nothing
        items = [x for x in items if not x[2] or not all(map(excluded, x[0]))]
    cut = 0
    while len(items) > most and any(x[2] for x in items):
        cut += 1
        out: list[list] = []
        for x in items:
            if x[2]:
                path = "/".join(os.path.commonprefix([p.split("/") for p in x[0]])[: -1 if cut < 2 else -2]) + "/*"
                one = [(path,), True, True, x[3], [[sum(s[0] for s in x[4]), VARIABLE]]]
                if out and out[-1][2] and out[-1][0] == one[0]:
                    one = _join(out.pop(), one, True)
                x = one
            out.append(x)
        if len(out) == len(items) and cut > 64:
            break
        items = out
    return items


def aligned(a: Wrapper, b: Wrapper) -> Wrapper:
    """One wrapper for the pages of two: what agrees is joined, the rest is optional."""
    out: list[list] = []
    i = j = 0
    for p, q in [*_matches(a[1], b[1]), (len(a[1]), len(b[1]))]:
        out += [[x[0], x[1], True, x[3], x[4]] for x in (*a[1][i:p], *b[1][j:q])]
        if p < len(a[1]):
            out.append(_join(a[1][p], b[1][q], False))
        i, j = p + 1, q + 1
    return a[0] + b[0], bounded(folded(out))


def _within(path: str, regions: tuple[str, ...]) -> bool:
    return any(path == r or path.startswith(f"{r}/") for r in regions)


def decisions(wrapper: Wrapper) -> tuple[str, ...]:
    """The article's regions on the wrapper's host, as path prefixes."""
    slots = [(path, x[3], s) for x in wrapper[1] for path, s in zip(x[0], x[4], strict=True) if not excluded(path)]
    # Text that only one page has is not known to be the template's.
    own = [(path, s[0]) for path, n, s in slots if s[1] == VARIABLE or n < 2] or [(path, s[0]) for path, _, s in slots]
    for tag in ("article", "main"):
        found: set[str] = set()
        for path, *_ in slots:
            at = next((k for k, e in enumerate(path.split("/")) if e.split(".")[0] == tag), None)
            if at is not None:
                found.add("/".join(path.split("/")[: at + 1]))
        regions = tuple(sorted(found))
        if regions and sum(n for path, n in own if _within(path, regions)) >= _TEASERS * sum(n for _, n in own):
            return regions
    if not own:
        return ()
    split = [p.split("/") for p in {path for path, _ in own}]
    if len(split) == 1:
        split[0].pop()
    return ("/".join(os.path.commonprefix(split)),)


def main_text(page: str | None, regions: tuple[str, ...]) -> str:
    """The article's blocks, each on a line."""
    found = [(path, text) for path, text in blocks(page) if not excluded(path)]
    own = [text for path, text in found if _within(path, regions)]
    if not own:  # a page unlike the others of its host: its own wrapper decides
        alone = decisions(page_wrapper(page))
        own = [text for path, text in found if _within(path, alone)]
    return "\n".join(own)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def _aligning(wrapper_of: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(host, x) rows of a task to one wrapper for each of its hosts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, Wrapper] = {}
        for b in batches:
            for host, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = wrapper_of(x.as_py())
                have[host] = aligned(have[host], w) if host in have else w
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have)), pa.array([pickle.dumps(w) for w in have.values()], pa.binary())], names=["host", "wrapper"])

    return run


def infer(pages: DataFrame, url_col: str, html_col: str, salts: int = 16) -> DataFrame:
    """(host, wrapper, regions): one wrapper for each host, from all its pages, and what it decides; written."""
    schema = "host string, wrapper binary"
    partial = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(lean(_aligning(page_wrapper)), schema)
    salted = partial.withColumn("salt", F.spark_partition_id() % salts).repartition("host", "salt").select("host", "wrapper").mapInArrow(lean(_aligning(pickle.loads)), schema)
    whole = salted.repartition("host").mapInArrow(lean(_aligning(pickle.loads)), schema)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regions = [list(decisions(pickle.loads(w.as_py()))) for w in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(regions, pa.list_(pa.string()))], names=["host", "wrapper", "regions"])

    return written(whole.mapInArrow(decide, f"{schema}, regions array<string>"), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sent: int = SENT) -> DataFrame:
    """id, url, text, n_chars for each page, from its whole html, however long it is.

    Null html has the empty text. Pages without a url, or with one that names no host,
    share a wrapper. Repeated rows give repeated rows; an empty table gives an empty
    result; other columns are not looked at. The hosts' regions go to every task if they
    are of ``sent`` bytes at most in all; more are joined by host, those of hosts with
    many pages by salts.
    """
    with scope() as kept:
        rules = written(infer(pages, url_col, html_col).select("host", "regions"), "page-regions")
        kept.append(rules)
    kind = pages.schema[id_col].dataType.simpleString()
    host = host_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    size = rules.agg(F.sum(F.length("host") + F.length(F.concat_ws("", "regions")) + 100)).first()[0] or 0
    known = None
    if size <= sent:
        known = pages.sparkSession.sparkContext.broadcast({r.host: tuple(r.regions) for r in rules.collect()})
    else:
        counts = pages.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))
        rows = skew.salted_join(rows, rules, "host", skew.hot_keys(counts, "host", "n"), F.monotonically_increasing_id()).select("id", "url", "html", "host", "regions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regions = [known.value[h] for h in b.column(3).to_pylist()] if known is not None else map(tuple, b.column(4).to_pylist())
            texts = [main_text(page.as_py(), r) for page, r in zip(b.column(2), regions, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    out = rows.mapInArrow(lean(run), f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
