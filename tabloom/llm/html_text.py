"""Main text of web pages by a site style tree (Yi, Liu and Li, 2003).

The elements of all pages of a host, whole pages before any rule, are merged into one tree: a node stands for elements
of one label (tag, classes, id) at one place among their like under one parent. Over the host's pages it has a
presentation entropy, of the sequences of children that it shows, and each of its contents has one (a text on every page
tells nothing). The importance of a page's branch is composed from below, from its contents' and its own; branches of low
importance go whole. With them goes what HTML itself marks as no part of the article (menus, headers, footers, sidebars,
forms, scripts, styles); words in class names lower a branch's importance.

A node is a number, a hash of its label seeded by its parent's, so that neither memory nor time grows with depth."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabloom.llm._common import joined, stored
from tabloom.llm.urls import host_of

#: Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math merror mfrac mi mn mo mover mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("head title nav header footer aside form script style noscript template iframe embed button select option textarea input dialog menu noembed noframes".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements that end an open one of the same group, and where the search for it stops.
GROUPS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Last words of class names and ids, and roles, of what is seldom part of an article; first words that
#: turn the sense of a class name.
MARKED = set("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead topbar footer comment comments reply replies disqus sharing newsletter signup login related recommended widget widgets toolbar pagination pager".split())
TURNED = set("no has with without is not".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: Share of a branch's own presentation, attenuated by each further style; importance below which a branch goes.
GAMMA, LEAST = 0.9, 0.3

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
MASK = (1 << 64) - 1


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text, seed & MASK)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if "=" in source or source.strip(" /") else {}


def _dropped(tag: str, own: dict[str, str], area: int) -> bool:
    """What HTML itself sets apart; the header of an article is part of it."""
    if tag in DROPPED and not (tag == "header" and area == 2):
        return True
    return bool(own) and ("hidden" in own or own.get("role", "").lower() in ROLES or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")) is not None)


def _marked(own: dict[str, str]) -> bool:
    """Whether a class name or the id ends with a marked word, and is not turned by its first one."""
    for name in f"{own.get('class', '')} {own.get('id', '')}".split():
        words = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower().strip("-_"))
        if words[-1] in MARKED and words[0] not in TURNED:
            return True
    return False


class Page:
    """A page's block elements, parents before children, and its blocks of text, in page order.

    Of each element: its parent, its node of the style tree, the hash of what it shows (labels of its children and inline
    elements, in order), whether a rule drops it or one around it, whether words mark it, and whether it is in a main
    element (1) or an article (2). A block has its element, its text, and whether an inline element drops it."""

    def __init__(self, source: str | None, host: str | None = ""):
        self.parent, self.node, self.shows, self.drop, self.mark, self.area, self.form = [-1], [_hash(host or "", 1)], [0], [False], [False], [0], [False]
        self.blocks: list[tuple[int, str]] = []
        self._like: list[Counter] = [Counter()]
        self._read(source or "")
        del self._like

    def _element(self, parent: int, tag: str, own: dict[str, str]) -> int:
        label = tag + "".join(f".{x}" for x in sorted(own.get("class", "").split())) + (f"#{own['id']}" if own.get("id") else "")
        self._like[parent][label] += 1
        area = 2 if tag == "article" else max(self.area[parent], int(tag == "main"))
        self.node.append(_hash(f"{label}:{self._like[parent][label]}", self.node[parent]))
        self.shows[parent] = _hash(label, self.shows[parent])
        self.parent.append(parent)
        self.shows.append(0)
        self.drop.append(self.drop[parent] or _dropped(tag, own, self.area[parent]))
        self.form.append(not (tag != "form" and _dropped(tag, own, self.area[parent])) and (tag == "form" and not self.drop[parent] or self.form[parent]))
        self.mark.append(tag not in ("html", "body", "main") and bool(own) and _marked(own))
        self.area.append(area)
        self._like.append(Counter())
        return len(self.node) - 1

    def _read(self, source: str) -> None:
        """Elements that aren't closed end with their parent, or where HTML says so; end tags without a start are skipped."""
        stack: list[tuple[str, int, bool]] = []  # tag, its element or the one around it, whether inline elements drop it
        opened: Counter = Counter()
        parts: list[str] = []
        here = 0  # the element that the open block belongs to
        at = 0

        def end_block() -> None:
            if parts and (text := SPACE.sub(" ", html.unescape("".join(parts))).strip()):
                self.blocks.append((here, text))
            parts.clear()

        def text(part: str) -> None:
            if part and not (stack and stack[-1][2]):
                parts.append(part)

        def pop_to(i: int) -> None:
            nonlocal here
            if any(x[0] not in INLINE for x in stack[i:]):
                end_block()
            for x in stack[i:]:
                opened[x[0]] -= 1
            del stack[i:]
            here = stack[-1][1] if stack else 0

        def close(kinds: set[str], stop: set[str]) -> None:
            if not any(opened[k] for k in kinds):
                return
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in kinds:
                    return pop_to(i)
                if stack[i][0] in stop:
                    return

        while m := TAG.search(source, at):
            text(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    text(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            if m[1] or m[4]:
                if tag == "br":
                    text(" ")
                for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                    if stack[i][0] == tag:
                        pop_to(i)
                        break
                    if tag in INLINE and stack[i][0] not in INLINE:  # never closes a block from within
                        break
                continue
            rest = m[3] or m[6] or ""
            if tag in CLOSES_P:
                close({"p"}, {"article", "section", "div", "td", "th", "li", "body", "main", "aside", "nav", "header", "footer", "form", "blockquote", "button"})
            if tag in GROUPS:
                close(*GROUPS[tag])
            if re.fullmatch("h[1-6]", tag) and stack and re.fullmatch("h[1-6]", stack[-1][0]):
                pop_to(len(stack) - 1)
            inline = tag in INLINE
            if not inline:
                end_block()
            else:
                self.shows[here] = _hash(tag, self.shows[here])
            if tag == "br":
                text(" ")
            if tag in VOID:
                continue
            own = _attributes(rest)
            gone = bool(stack and stack[-1][2])
            if inline:
                stack.append((tag, here, gone or bool(own) and (_dropped(tag, own, 0) or _marked(own))))
            else:
                here = self._element(here, tag, own)
                stack.append((tag, here, gone))
            opened[tag] += 1
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                if tag not in ("script", "style"):
                    text(source[at : end.start() if end else len(source)])
                at = end.end() if end else len(source)
                pop_to(len(stack) - 1)
            elif rest.rstrip().endswith("/") and tag in ("svg", "math"):
                pop_to(len(stack) - 1)
        text(source[at:])
        end_block()

    def seen(self) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
        """What the page tells the style tree: (node, what it shows) and (node, hash of a content)."""
        return set(zip(self.node, self.shows, strict=True)), {(self.node[e], _hash(t, 2)) for e, t in self.blocks}


def content_key(node: int, content: int) -> int:
    return _hash(f"{node}", content)


def importance(page: Page, nodes: dict[int, tuple[float, int]], contents: dict[int, float], gamma: float = GAMMA) -> tuple[list[float], list[float]]:
    """Of each element and each block. nodes: presentation entropy and number of styles of nodes that several pages have;
    contents: importance of contents that several pages have, by content_key. All else is as important as can be.

    A branch's importance is (1 - gamma ** styles) of its own presentation's and gamma ** styles of its blocks' and
    children's mean by length of text."""
    n = len(page.node)
    size, total = [0] * n, [0.0] * n
    own = [contents.get(content_key(page.node[e], _hash(t, 2)), 1.0) for e, t in page.blocks]
    for (e, t), x in zip(page.blocks, own, strict=True):
        size[e] += len(t)
        total[e] += len(t) * x
    out = [1.0] * n
    for e in range(n - 1, -1, -1):  # children come after their parents
        below = total[e] / size[e] if size[e] else 1.0
        entropy, styles = nodes.get(page.node[e], (1.0, 1))
        out[e] = (1 - gamma**styles) * entropy + gamma**styles * below
        if e:
            up = page.parent[e]
            size[up] += size[e]
            total[up] += size[e] * out[e]
    return out, own


def kept(page: Page, nodes: dict[int, tuple[float, int]], contents: dict[int, float], least: float = LEAST) -> list[int]:
    """Numbers of the blocks that stay: of the articles if those hold a quarter of what stays at all, else of the main
    element if that does, else all. A branch with a marked word counts a fifth of its importance, unless it holds half of
    the page's text. If nothing stays, the rules of HTML decide alone, a form around all being none."""
    branch, own = importance(page, nodes, contents)
    n = len(page.node)
    size = [0] * n
    for e, t in page.blocks:
        size[e] += 0 if page.drop[e] else len(t)
    for e in range(n - 1, 0, -1):
        size[page.parent[e]] += size[e]
    gone = [False] * n
    for e in range(1, n):
        low = page.mark[e] and 2 * size[e] <= size[0]
        gone[e] = gone[page.parent[e]] or branch[e] * (0.2 if low else 1.0) < least
    stay = [i for i, (e, _) in enumerate(page.blocks) if not page.drop[e] and not gone[e] and own[i] >= least]
    stay = stay or [i for i, (e, _) in enumerate(page.blocks) if not page.drop[e]]
    stay = stay or [i for i, (e, _) in enumerate(page.blocks) if page.form[e]]
    length = lambda some: sum(len(page.blocks[i][1]) for i in some)
    for area in (2, 1):
        inner = [i for i in stay if page.area[page.blocks[i][0]] >= area]
        if inner and 4 * length(inner) >= length(stay):
            return inner
    return stay


def main_text(page: Page, nodes: dict[int, tuple[float, int]] | None = None, contents: dict[int, float] | None = None) -> str:
    return "\n\n".join(page.blocks[i][1] for i in kept(page, nodes or {}, contents or {}))


def _signed(x: int) -> int:
    return x - (1 << 64) * (x >> 63)


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, pages, entropy, styles) of the nodes that several pages have, and (key, importance) of the contents that
    several pages have at a node, by content_key.

    Entropies are taken to base pages, so that 1 is as varied as can be. A content's importance is 1 - log(c) / log(m +
    1) where c of the node's m pages have it: what two of two pages have counts for more than what ten of ten do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[], [], []]
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for content, found in enumerate(Page(source, host).seen()):
                    for node, feature in found:
                        rows[0].append(_signed(node))
                        rows[1].append(bool(content))
                        rows[2].append(_signed(feature))
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["node", "content", "feature"])

    seen = pages.select(host_of(F.col("url")).alias("host"), F.col("html")).mapInArrow(run, "node long, content boolean, feature long")
    features = stored(seen.groupBy("node", "content", "feature").agg(F.count("*").alias("c")), "style-features")
    c, m = F.col("c").cast("double"), F.col("pages").cast("double")
    nodes = features.where("not content").groupBy("node").agg(F.sum("c").alias("pages"), F.sum(c * F.log(c)).alias("spread"), F.count("*").cast("int").alias("styles")).where("pages > 1")
    nodes = stored(nodes.select("node", "pages", ((F.log(m) - F.col("spread") / m) / F.log(m)).alias("entropy"), "styles"), "style-nodes")
    shared = joined(features.where("content and c > 1").select("node", "feature", "c"), nodes.select("node", "pages"), ["node"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_signed(content_key(n & MASK, f & MASK)) for n, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(2)], ["key", "importance"])

    value = shared.select("node", "feature", (1 - F.log("c") / F.log(m + 1)).alias("importance"))
    return nodes, value.mapInArrow(keyed, "key long, importance double")


class _Shared:
    """Keys of nodes and contents with their values, as sorted arrays."""

    def __init__(self, rows: list[tuple[int, float, int]]):
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.int64)
        self.value = np.array([r[1] for r in rows])
        self.styles = np.array([r[2] for r in rows], np.int32)

    def of(self, page: Page) -> tuple[dict[int, tuple[float, int]], dict[int, float]]:
        if not len(self.keys):
            return {}, {}
        keys = [*page.node, *(content_key(page.node[e], _hash(t, 2)) for e, t in page.blocks)]
        own = np.array([_signed(k) for k in keys], np.int64)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        nodes, contents = {}, {}
        for k, i, hit in zip(keys, at.tolist(), (self.keys[at] == own).tolist(), strict=True):
            if hit and self.styles[i]:
                nodes[k] = (float(self.value[i]), int(self.styles[i]))
            elif hit:
                contents[k] = float(self.value[i])
        return nodes, contents


def extract(pages: DataFrame, most_broadcast: int = 200_000) -> DataFrame:
    """page_id, url, text and n_chars (code points), a row per row of pages.

    Null html is empty and has an empty text, as has a page without text; a null url belongs to the host without a name;
    null ids and repeated rows stay, a repeated page counting as a page of its own; an empty table gives an empty one,
    and columns other than these three are not read. A page of which nothing would stay keeps what the rules of HTML
    leave. What the tree tells of shared nodes is broadcast while it has at most most_broadcast rows, 20 bytes each;
    beyond that every page's nodes are joined with it, so that no task holds more than a page's own."""
    nodes, contents = style_tree(pages)
    shared = nodes.select(F.col("node").alias("key"), F.col("entropy").alias("value"), "styles").unionByName(contents.where(F.col("importance") < 1).select("key", F.col("importance").alias("value"), F.lit(0).alias("styles")))
    shared = stored(shared.groupBy("key").agg(F.min("value").alias("value"), F.min("styles").alias("styles")), "style-shared")
    own = pages.select(F.col("page_id"), F.col("url"), F.col("html"), host_of(F.col("url")).alias("host"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def texts(b: pa.RecordBatch, values: Iterator[_Shared]) -> pa.RecordBatch:
        out = []
        for source, host, known in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), values, strict=False):
            page = Page(source, host)
            out.append(main_text(page, *known.of(page)))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    if shared.count() <= most_broadcast:
        small = pages.sparkSession.sparkContext.broadcast(_Shared([tuple(r) for r in shared.collect()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield texts(b, repeat(small.value))

        return own.mapInArrow(run, schema)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for row, host, source in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                page = Page(source, host)
                of = {*page.node, *(content_key(page.node[e], _hash(t, 2)) for e, t in page.blocks)}
                rows += [row] * len(of)
                found += map(_signed, of)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.int64())], ["row", "key"])

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield texts(b, (_Shared([(r["key"], r["value"], r["styles"]) for r in x or ()]) for x in b.column(4).to_pylist()))

    own = stored(own.withColumn("row", F.monotonically_increasing_id()), "style-pages")
    asked = stored(own.select("row", "host", "html").mapInArrow(keys, "row long, key long"), "style-keys")
    told = joined(asked, shared, ["key"]).groupBy("row").agg(F.collect_list(F.struct("key", "value", "styles")).alias("told"))
    return own.join(told, "row", "left").select("page_id", "url", "html", "host", "told").mapInArrow(run_joined, schema)
