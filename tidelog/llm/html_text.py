"""Main-text extraction: nearest-URL page differencing for lines that the page's own structure leaves open."""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate, count, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, written
from tidelog.llm.url_filter import host_of, path_of

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements that are never main text.
_BOILERPLATE = {"aside", "button", "datalist", "dialog", "fieldset", "footer", "form", "frameset", "head", "header", "label", "menu", "nav", "object", "select", "svg", "template", "audio", "canvas", "video", "math"}
#: Words of a class, id or role that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
_MARKED = re.compile(r"(?:^|[\s_-])(?:ad|ads|adbox|advert\w*|alert|banner\w*|breadcrumbs?|comments?|commentlist|complementary|consent|contentinfo|cookies?|disqus\w*|footer|form|gdpr|header|login|masthead|menu\w*|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|reply|respond|search|share|sharing|sidebar\w*|signup|social|sponsor\w*|subscribe|toolbar|widget\w*)(?=$|[\s_-])", re.I)
_MAIN = {"article", "main"}
#: What a start tag of the key closes if it is the innermost open element.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

ARTICLE, OPEN, BOILERPLATE = 0, 1, 2


class _Tokens:
    """The tokens of a page in one pass: text, and tags as (text before, name or None, whether an end tag, attributes).

    A tag ends at the first > outside of quotes. Where a tag never ends that way, it and all tags after it end at their first >, and a < with no > after it is
    text. So at most one scan of the page is in vain, whatever its quotes.
    """

    def __init__(self, page: str) -> None:
        self.page, self.at, self.quotes, self.last = page, 0, True, page.rfind(">")

    def _end(self, at: int) -> int:
        """Where the tag whose attributes start here has its >; -1 for nowhere."""
        page, here = self.page, at
        while self.quotes:
            stop = _STOP.search(page, here)
            if stop is None:
                break
            if stop[0] == ">":
                return stop.start()
            here = page.find(stop[0], stop.end()) + 1
            if not here:
                break
        self.quotes = False
        return page.find(">", at) if at <= self.last else -1

    def skip_to(self, pattern: re.Pattern) -> None:
        """Leave out all up to the end of a match, or to the end of the page."""
        found = pattern.search(self.page, self.at)
        self.at = found.end() if found else len(self.page)

    def __iter__(self) -> Iterator[tuple[str, str | None, bool, str]]:
        page, text, look = self.page, 0, 0
        while (i := page.find("<", look)) >= 0:
            name, closing, attrs = None, False, ""
            if page.startswith("<!--", i) or page.startswith("<![CDATA[", i):
                mark, start = ("-->", i + 4) if page.startswith("<!--", i) else ("]]>", i + 9)
                stop = page.find(mark, start)
                stop = len(page) if stop < 0 else stop
                end = stop + 3
                if mark == "]]>":
                    attrs = page[start:stop]
            elif page.startswith(("<!", "<?"), i):
                stop = page.find(">", i)
                end = len(page) if stop < 0 else stop + 1
            elif i > self.last:
                break
            else:
                closing = page.startswith("</", i)
                found = _NAME.match(page, i + 1 + closing)
                stop = self._end(found.end()) if found else -1
                if stop < 0:
                    look = i + 1
                    continue
                name, attrs, end = found[0].lower(), page[found.end() : stop], stop + 1
            self.at = end
            yield page[text:i], name, closing, attrs
            text = look = self.at
        yield page[text:], None, False, ""


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each non-empty block in page order: white space runs as one space, character references decoded.

    Zone ARTICLE: inside an article or main element; BOILERPLATE: inside an element that is never main text, by its name or a
    mark in its class, id or role; OPEN: neither. The innermost of these that is open decides, but an article inside comments is a comment.
    Time grows in proportion to the page, whatever its nesting.
    """
    if not page:
        return []
    out: list[tuple[int, str]] = []
    piece: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, zone, whether inside comments
    of_blocks: list[int] = []  # where in the stack block elements are
    opened: Counter[str] = Counter()
    zone = OPEN

    def flush() -> None:
        if piece:
            if text := " ".join("".join(piece).split()):
                out.append((zone, text))
            piece.clear()

    def pop_to(n: int) -> None:
        nonlocal zone
        below = stack[n - 1][1] if n else OPEN
        if of_blocks and of_blocks[-1] >= n or zone != below:
            flush()
        while of_blocks and of_blocks[-1] >= n:
            of_blocks.pop()
        for name, _, _ in stack[n:]:
            opened[name] -= 1
        del stack[n:]
        zone = below

    tokens = _Tokens(page)
    for text, name, closing, attrs in tokens:
        if text:
            piece.append(html.unescape(text))
        if name is None:
            if attrs:
                piece.append(attrs)
        elif closing:
            if name == "br":
                piece.append(" ")
            if opened[name]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name in _BLOCK:
                flush()
        elif name in _RAW:
            tokens.skip_to(_RAW_END[name])
        elif name == "br":
            piece.append(" ")
        else:
            if name in _BLOCK:
                flush()
                if of_blocks and (stack[of_blocks[-1]][0] == "p" or stack[of_blocks[-1]][0] in _CLOSES.get(name, ())):
                    pop_to(of_blocks[-1])
            if name in _VOID or attrs.endswith("/") and name not in _BLOCK:
                continue
            mark = " ".join(a[1] or a[2] or a[3] for a in _ATTR.findall(attrs)) if attrs else ""
            new, comments = zone, bool(stack) and stack[-1][2]
            if name in _BOILERPLATE or (mark and name not in ("html", "body", "article", "main") and _MARKED.search(mark)):
                new = BOILERPLATE
            elif name in _MAIN and not (comments and zone == BOILERPLATE):
                new = BOILERPLATE if mark and re.search(r"comment|reply|respond", mark, re.I) else ARTICLE
            if new != zone:
                flush()
            comments = comments or new == BOILERPLATE and bool(mark) and bool(re.search(r"comment|disqus|repl|respond", mark, re.I))
            if name in _BLOCK:
                of_blocks.append(len(stack))
            stack.append((name, new, comments))
            opened[name] += 1
            zone = new
    flush()
    return out


def _matched(x: list[int], y: list[int]) -> np.ndarray:
    """For j = 0..len(y), the length of a longest common subsequence of x and y[:j]: the zeros among the first j bits after the last row (Hyyro, 2004)."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = row = (1 << len(y)) - 1
    for v in x:
        if m := where.get(v, 0):
            u = row & m
            row = ((row + u) | (row - u)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(y) // 8), "little"), dtype=np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b, in memory that grows with the lines alone (Hirschberg, 1975)."""
    both = set(a) & set(b)
    todo = [([(i, v) for i, v in enumerate(a) if v in both], [v for v in b if v in both])]
    found = []
    while todo:
        x, y = todo.pop()
        head = 0
        while head < min(len(x), len(y)) and x[head][1] == y[head]:
            head += 1
        tail = 0
        while tail < min(len(x), len(y)) - head and x[-1 - tail][1] == y[-1 - tail]:
            tail += 1
        found += [i for i, _ in x[:head]] + [i for i, _ in x[len(x) - tail :]]
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        if not x or not y:
            continue
        if len(x) == 1:
            found += [x[0][0]] if x[0][1] in y else []
            continue
        half = len(x) // 2
        values = [v for _, v in x]
        j = int(np.argmax(_matched(values[:half], y) + _matched(values[:half - 1 : -1], y[::-1])[::-1]))
        todo += [(x[:half], y[:j]), (x[half:], y[j:])]
    return sorted(found)


def main_text(parts: list[tuple[int, str]]) -> str:
    """The lines that aren't boilerplate, in the page's order; joined by newlines."""
    return "\n".join(t for z, t in parts if z != BOILERPLATE)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each page once: the text of its lines that aren't boilerplate, and what differencing needs of all its lines: zones, sizes, hashes, and a digest of these."""
    for b in batches:
        rows = []
        for p in b["html"]:
            parts = blocks(p)
            hashes = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for _, t in parts], dtype="<u8").tobytes()
            zones = bytes(z for z, _ in parts)
            digest = int(np.uint64(xxhash.xxh64_intdigest(hashes + zones)).astype(np.int64))
            rows.append((main_text(parts), zones, np.array([len(t) for _, t in parts], dtype="<i4").tobytes(), hashes, digest))
        yield b[["page_id", "url", "host", "path"]].assign(page_id=b["page_id"].astype("Int64"), **{c: [r[k] for r in rows] for k, c in enumerate(("text", "zones", "sizes", "lines", "digest"))})


def _nearness(a: str, b: str) -> int:
    """Length of the common start of two paths."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _among(lines: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which of the lines are among others, which are in order."""
    return ascending.take(ascending.searchsorted(lines), mode="clip") == lines if len(ascending) else np.zeros(len(lines), dtype=bool)


class _Page:
    """A page as differencing sees it."""

    def __init__(self, host, path, digest, zones, sizes, lines) -> None:
        self.host, self.path, self.digest = host, path, digest
        self.zones, self.sizes, self.lines = np.frombuffer(zones, dtype=np.uint8), np.frombuffer(sizes, dtype="<i4"), np.frombuffer(lines, dtype="<u8")

    @cached_property
    def open(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Its open lines, their sizes, and how often a line is among them at most."""
        open_ = self.zones == OPEN
        return self.lines[open_], self.sizes[open_].astype("<i8"), int(np.unique(self.lines[open_], return_counts=True)[1].max(initial=0))

    def has_copy(self, other: _Page, copied: float) -> bool:
        """Whether the other page has lines that hold the share `copied` of this page's open characters: then it repeats the text itself, and can't tell text from frame."""
        open_ = self.zones == OPEN
        return self.sizes[open_ & np.isin(self.lines, other.lines)].sum() >= copied * self.sizes[open_].sum()


class _Bound:
    """What holds of all pages of a run of a host's pages, to tell without them that each repeats a page's text: lines (distinct, ascending), and how many characters of these any of the pages lacks at most."""

    def __init__(self, lines, weights, radius: int, first: str, last: str) -> None:
        self.lines, self.weights, self.radius, self.first, self.last = lines, weights, radius, first, last

    @classmethod
    def of(cls, page: _Page) -> _Bound:
        lines, at = np.unique(page.lines, return_index=True)
        return cls(lines, page.sizes[at].astype("<i8"), 0, page.path, page.path)

    @classmethod
    def over(cls, parts: list[_Bound]) -> _Bound:
        """Of successive runs together: the lines that most of them have, for near copies those of the text that they were made from."""
        if len(parts) == 1:
            return parts[0]
        lines, at, n = np.unique(np.concatenate([x.lines for x in parts]), return_index=True, return_counts=True)
        most = n * 2 > len(parts)
        lines, weights = lines[most], np.concatenate([x.weights for x in parts])[at[most]]
        return cls(lines, weights, max(int(weights[~_among(lines, x.lines)].sum()) + x.radius for x in parts), parts[0].first, parts[-1].last)

    def all_copies_of(self, x: _Page, copied: float) -> bool:
        """Whether each page surely has lines that hold the share `copied` of x's open characters; False leaves it open. What a page lacks of x's is not among these lines, or is among these and lacking there, as often as x repeats it."""
        lines, sizes, repeated = x.open
        return sizes[_among(lines, self.lines)].sum() - repeated * self.radius >= copied * sizes.sum()


class _Tree:
    """Bounds of a host's leaves, runs of its ordered pages with successive numbers, and over each `fan` of them, level by level."""

    def __init__(self, start: int, leaves: list[_Bound], fan: int = 16) -> None:
        self.start, self.fan, self.levels = start, fan, [leaves]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([_Bound.over(below[i : i + fan]) for i in range(0, len(below), fan)])

    def leaves(self, x: _Page, leaf: int, side: int, least: int, copied: float) -> Iterator[int]:
        """From a leaf on, to the side, the leaves in which a page that doesn't repeat x's text, and is nearer by path than `least`, can't be ruled out."""
        todo = [(len(self.levels) - 1, 0)]
        while todo:
            level, i = todo.pop()
            node, low = self.levels[level][i], i * self.fan**level
            high = min(low + self.fan**level, len(self.levels[0])) - 1
            if (high if side > 0 else -low) < side * (leaf - self.start) or _nearness(x.path, node.first if side > 0 else node.last) <= least and not low <= leaf - self.start <= high or node.all_copies_of(x, copied):
                continue
            if not level:
                yield self.start + i
                continue
            below = range(i * self.fan, min((i + 1) * self.fan, len(self.levels[level - 1])))
            todo += [(level - 1, c) for c in (reversed(below) if side > 0 else below)]


def _gone(x: _Page, pair: _Page) -> list[int]:
    """Which of x's lines, numbered without boilerplate, are open and shared with its pair."""
    number = np.cumsum(x.zones != BOILERPLATE) - 1
    return [int(number[i]) for i in common_lines(x.lines.tolist(), pair.lines.tolist()) if x.zones[i] == OPEN]


_PAGE = ("host", "path", "digest", "zones", "sizes", "lines")
#: A page's pair on trial (side 0: what it shares with a page so near by path and so far in the order), or a page whose pair is still sought on a side, among pages nearer by path than `least`.
_SOUGHT = "digest long, host string, near int, dist long, gone array<int>, side int, least int, g long, path string, zones binary, sizes binary, lines binary"


def _trial(x: _Page, g: int, near: int, dist: int, gone: list[int]) -> tuple:
    return x.digest, x.host, near, dist, gone, 0, -1, g, None, None, None, None


def _sought(x: _Page, g: int, beside: list[tuple[int, _Page]], window: int, copied: float) -> list[tuple]:
    """Rows of _SOUGHT for a page and those beside it: (distance in the order, page), `window` on either side unless the order ends. On a side, pages are the less near by path the further they are."""
    if OPEN not in x.zones:
        return []
    near = sorted(((-_nearness(x.path, y.path), abs(d), d, y) for d, y in beside if y.host == x.host), key=lambda y: y[:3])
    pair = next((y for y in near if not x.has_copy(y[3], copied)), None)
    least = -pair[0] if pair else -1
    sides = [side for side in (-1, 1) if any(d == side * window and -n > least for n, _, d, _ in near)]
    gone = _gone(x, pair[3]) if pair else []
    rows = [_trial(x, g, least, pair[2], gone)] if gone or pair and sides else []
    whole = x.path, x.zones.tobytes(), x.sizes.tobytes(), x.lines.tobytes()
    return rows + [(x.digest, x.host, 0, 0, None, side, least, g, *whole) for side in sides]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _SOUGHT.split(", ")])


def _directory(ranged: DataFrame, sought: DataFrame, leaf: int, most: int) -> tuple[int, dict[str, _Tree]]:
    """The size of a leaf, at least `leaf` pages and so large that all bounds take at most `most` bytes, and the trees of the hosts where pairs are sought and that lie in three leaves or more."""
    hosts = ranged.join(sought.select("host").distinct(), "host", "left_semi").groupBy("host").agg(F.min("g").alias("a"), F.max("g").alias("z"))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, runs, pages = None, [], []

        def row() -> tuple:
            x = _Bound.over([*runs, *([_Bound.over(pages)] if pages else [])])
            return at[1], at[0], x.first, x.last, x.lines.tobytes(), x.weights.tobytes(), x.radius

        names = ["host", "leaf", "first", "last", "lines", "weights", "radius"]
        for batch in batches:
            out = []
            for r in zip(batch["leaf"], *(batch[c] for c in _PAGE), strict=True):
                if at != r[:2]:
                    out += [row()] if at else []
                    at, runs, pages = r[:2], [], []
                pages.append(_Bound.of(_Page(*r[1:])))
                if len(pages) == 16:
                    runs.append(_Bound.over(pages))
                    pages = []
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([row()] if at else [], columns=names)

    while True:
        number = lambda c: F.expr(f"{c} div {leaf}")  # noqa: B023, E731
        pages = ranged.join(hosts.where(number("z") - number("a") > 1).select("host"), "host", "left_semi").withColumn("leaf", number("g"))
        got = written(pages.select("leaf", "g", *_PAGE).repartition("leaf").sortWithinPartitions("leaf", "g").mapInPandas(bounds, "host string, leaf long, first string, last string, lines binary, weights binary, radius long"))
        if (got.agg(F.sum(F.length("lines") + F.length("weights") + F.length("first") + F.length("last"))).first()[0] or 0) <= most:
            break
        leaf *= 4
    leaves: dict[str, list] = {}
    for r in sorted(got.collect(), key=lambda r: (r["host"], r["leaf"])):
        leaves.setdefault(r["host"], []).append((r["leaf"], _Bound(np.frombuffer(r["lines"], "<u8"), np.frombuffer(r["weights"], "<i8"), r["radius"], r["first"], r["last"])))
    return leaf, {h: _Tree(x[0][0], [y for _, y in x]) for h, x in leaves.items()}


def _sought_further(ranged: DataFrame, sought: DataFrame, window: int, copied: float, leaf: int, directory: int, load: int) -> list[DataFrame]:
    """Trials for the pages whose pair the pages beside them leave open: on each side, with the nearest page of all the host's that doesn't repeat the text.

    The host's pages lie in leaves. By a tree of bounds over them a page passes those in which all pages surely repeat its text, so a large group of near copies costs it few
    steps; of the rest it visits one, then the next two, four and so on, until a pair is found or the host ends. A leaf that many pages visit is met in several tasks.
    """
    spark = ranged.sparkSession
    leaf, trees = _directory(ranged, sought, leaf, directory)
    shared = spark.sparkContext.broadcast(trees)
    pages = ranged.select(F.expr(f"g div {leaf}").alias("leaf"), "g", *_PAGE)
    trials: list[DataFrame] = []

    def visits(turn: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                leaves = []
                for side, least, g, *page in zip(*(b[c] for c in ("side", "least", "g", *_PAGE)), strict=True):
                    x, at, tree = _Page(*page), (g + side * window) // leaf, shared.value.get(page[0])
                    these = tree.leaves(x, at, side, least, copied) if tree else iter((at, at + side))
                    leaves.append([int(k) for k in islice(these, (1 << turn) - 1, (2 << turn) - 1)])
                yield b.assign(leaves=leaves)

        return run

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        waiting: dict[str, list] = {}
        chunk: list[tuple[int, _Page]] = []

        def met() -> list[tuple]:
            """Rows for those that find their pair in the chunk's pages, which are one host's, nearest first."""
            out, left = [], []
            side, host = at[1], chunk[0][1].host
            bound = _Bound.over([_Bound.of(y) for _, y in chunk]) if waiting.get(host) else None
            for g, least, x in waiting.get(host, ()):
                beyond = [(h, y) for h, y in chunk if side * (h - g) > window]
                done = False
                if beyond and not bound.all_copies_of(x, copied):
                    for h, y in beyond:
                        near = _nearness(x.path, y.path)
                        if done := near <= least:
                            break
                        if done := not x.has_copy(y, copied):
                            out.append(_trial(x, g, near, h - g, _gone(x, y)))
                            break
                if not done:
                    left.append((g, least, x))
            waiting[host] = left
            chunk.clear()
            return out

        for batch in batches:
            out = []
            for r in zip(*(batch[c] for c in ("leaf", "side", "salt", "asks", "least", "g", *_PAGE)), strict=True):
                key, (asks, least, g), page = r[:3], r[3:6], r[6:]
                if chunk and (key != at or len(chunk) == 16 or chunk[0][1].host != page[0]):
                    out += met()
                if key != at:
                    at = key
                    waiting.clear()
                if asks:
                    waiting.setdefault(page[0], []).append((g, least, _Page(*page)))
                elif waiting.get(page[0]):
                    chunk.append((g, _Page(*page)))
            yield _frame(out)
        yield _frame(met() if chunk else [])

    for turn in count():
        going = written(sought.mapInPandas(visits(turn), f"{_SOUGHT}, leaves array<long>").where(F.size("leaves") > 0))
        asking = going.select(F.explode("leaves").alias("leaf"), "side", "least", "g", *_PAGE)
        loads = written(asking.groupBy("leaf", "side").agg(F.greatest(F.ceil(F.count(F.lit(1)) / load), F.ceil(F.sum(F.length("lines")) / (32 << 20))).cast("int").alias("salts")))
        if loads.isEmpty():
            return trials
        asking = asking.join(loads, ["leaf", "side"]).withColumn("salt", F.pmod(F.xxhash64("g"), F.col("salts")).cast("int")).withColumn("asks", F.lit(True)).drop("salts")
        there = pages.join(loads, "leaf").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).withColumn("asks", F.lit(False)).withColumn("least", F.lit(-1)).drop("salts")
        both = asking.unionByName(there).repartition("leaf", "side", "salt").sortWithinPartitions("leaf", "side", "salt", F.desc("asks"), F.col("side") * F.col("g"))
        found = written(both.mapInPandas(meet, _SOUGHT))
        trials.append(found)
        sought = written(going.drop("leaves").join(found.select("g", F.signum("dist").cast("int").alias("side")), ["g", "side"], "left_anti").select(*sought.columns), drop=(going, loads))


def shared_open_lines(parsed: DataFrame, window: int = 4, copied: float = 0.9, block: int = 4096, leaf: int = 256, directory: int = 16 << 20, load: int = 4096) -> DataFrame:
    """(digest, host, gone): for pages with open lines, which of their lines that aren't boilerplate the nearest page of the host has too. digest: of the page's lines.

    parsed: as _parse gives it. Pages of a host with equal lines are one, at their first path. Pages without lines are left out. The rest
    are put in order of host and path; a page's pair is the nearest by path (then by order) of its host's pages that don't repeat its text (has_copy). It is sought among the
    `window` pages before and after it first. Ordered pages are dealt into blocks of one size, each with the `window` pages around it, so a host that holds most pages is spread,
    and where blocks are cut makes no difference. Where these leave the pair open, it is sought in all the host's pages (_sought_further). A page whose host has no other text has no pair.
    """
    spark = parsed.sparkSession
    order = ["host", "path", "digest"]
    outline = parsed.where(F.length("lines") > 0).groupBy("host", "digest").agg(F.min("path").alias("path"), F.min("zones").alias("zones"), F.min("sizes").alias("sizes"), F.min("lines").alias("lines"))
    ranged = written(outline.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()))
    task = F.shiftright("m", 33).cast("int")
    counts = sorted((r["task"], r["n"]) for r in ranged.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task
    starts = list(accumulate((n for _, n in counts), initial=0))
    first = spark.createDataFrame([(t, s) for (t, _), s in zip(counts, starts[:-1], strict=True)], "task int, first long")
    ranged = ranged.withColumn("task", task).join(F.broadcast(first), "task").withColumn("g", F.col("first") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    low, high = F.greatest(F.lit(0), F.floor((F.col("g") - window) / block)), F.floor((F.col("g") + window) / block)
    dealt = ranged.withColumn("block", F.explode(F.sequence(low, high))).select(*order, "zones", "sizes", "lines", "g", "block")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "g")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque[tuple[int, int, _Page]] = deque()  # the last 2 * window + 1 pages of the block
        of = None

        def judged(k: int) -> list[tuple]:
            b, g, x = held[k]
            if g // block != b:
                return []
            return _sought(x, g, [(h - g, y) for _, h, y in held if h != g and abs(h - g) <= window], window, copied)

        def rest() -> list[tuple]:
            return [r for k in range(len(held)) if held[-1][1] - held[k][1] < window for r in judged(k)]

        for batch in batches:
            out = []
            for r in zip(batch["block"], batch["g"], *(batch[c] for c in _PAGE), strict=True):
                if r[0] != of:
                    out += rest()
                    held.clear()
                    of = r[0]
                held.append((r[0], r[1], _Page(*r[2:])))
                if len(held) > 2 * window + 1:
                    held.popleft()
                if len(held) > window:
                    out += judged(len(held) - 1 - window)
            yield _frame(out)
        yield _frame(rest())

    judged = written(dealt.mapInPandas(compare, _SOUGHT))
    trials, sought = judged.where("side = 0"), judged.where("side != 0")
    if not sought.isEmpty():
        for more in _sought_further(ranged, sought, window, copied, leaf, directory, load):
            trials = trials.unionByName(more)
        trials = trials.groupBy("digest", "host").agg(F.min_by("gone", F.struct(-F.col("near"), F.abs("dist"), F.col("dist"))).alias("gone"))
    return trials.where(F.size("gone") > 0).select("digest", "host", "gone")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = 100_000) -> DataFrame:
    """(id, url, text, n_chars) for every row of pages.

    Blocks that the structure marks as boilerplate are deleted, blocks of an article or main element are kept (two copies
    of an article share all its lines, so differencing must not judge those), and of the rest those are deleted that the page's nearest neighbour by
    URL has too. A page is parsed once, into a written table. Null and empty html give an empty text. Repeated rows and null ids are treated each by
    itself; pages without a host are pairs among themselves. Other columns of pages are left out.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    parsed = written(rows.mapInPandas(_parse, "page_id long, url string, host string, path string, text string, zones binary, sizes binary, lines binary, digest long"))
    gone = written(shared_open_lines(parsed))
    n = gone.count()
    out = parsed.select("page_id", "url", "host", "digest", "text").join(F.broadcast(gone) if n <= broadcast_rows else gone, ["digest", "host"], "left") if n else parsed.withColumn("gone", F.lit(None).cast("array<int>"))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract over all pages."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
