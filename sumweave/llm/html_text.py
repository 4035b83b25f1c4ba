"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, slices

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open element of the given names, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot select article section div main body".split())
#: Elements without running text: scripts, styles, controls, embedded objects.
SILENT = frozenset("script style noscript template head title button select option textarea iframe object svg canvas datalist audio video noembed noframes".split())
#: Elements, and whole names in class, id or role, that speak against a part beside or inside the main text, never against the main text itself or
#: what holds it; compound names (no-sidebar, search-methods) say nothing. FIRM ones mean a part of up to half the chosen text, LOOSE ones, which
#: also name what articles are about, only a part that is mostly links or very short.
ASIDE = frozenset("nav aside footer form menu dialog".split())
FIRM = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies disqus footer masthead nav navbar navigation newsletter pagination sidebar sponsor sponsored subscribe".split()
)
LOOSE = frozenset("alert banner menu modal notice notification popup promo related replies reply respond responses search share sharing social tags toolbar widget".split())
HELD = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text, which may stand alone beside the chosen element.
PROSE = HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())
#: Share of the chosen text up to which a part with a FIRM name goes, and one with a LOOSE name.
SHORT, VERY_SHORT = 0.5, 0.1
#: Share of the largest density sum that a declared article beside it needs to be preferred, and that a neighbour needs to belong to the text.
DECLARED, PART = 0.4, 0.2
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)


class Tree:
    """Elements of a page in document order; text belongs to the element that holds it. against: up to which share of the chosen text a part goes for
    its name."""

    def __init__(self, page: str):
        self.tag, self.parent, self.silent, self.against = ["#root"], [-1], [False], [0.0]
        self.open = Counter()  # elements on the stack, by name
        self.events: list[tuple[int, str | None]] = []  # (element, text); a block's start and end are entries with None
        stack, at, n = [0], 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.events.append((stack[-1], page[at:lt]))
            if lt == n:
                break
            m = _TAG.match(page, lt)
            if not m:
                self.events.append((stack[-1], "<"))
                at = lt + 1
                continue
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(stack, name)
                continue
            at = self._open(stack, name, m[3], page, at)

    def _open(self, stack: list[int], name: str, attributes: str, page: str, at: int) -> int:
        if name in BLOCK:
            self._close_to(stack, {"p"}, frozenset())
        if name in CLOSES:
            self._close_to(stack, CLOSES[name], HOLDERS - {"body"} if name != "body" else frozenset())
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.silent.append(name in SILENT or self.silent[stack[-1]])
        against = SHORT if name in ASIDE or name == "header" and not (self.open["article"] or self.open["main"]) else 0.0
        if attributes and name not in HELD:
            names = {x for a in _ATTRIBUTE.finditer(attributes) if a[1].lower() in ("class", "id", "role") for x in (a[2] or a[3] or a[4] or "").lower().split()}
            against = SHORT if against or names & FIRM else VERY_SHORT if names & LOOSE else 0.0
        self.against.append(against)
        if name in BLOCK:
            self.events.append((node, None))
        elif name == "br":
            self.events.append((stack[-1], " "))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            return end.end() if end else len(page)
        if name not in VOID and not (attributes.rstrip().endswith("/") and name not in BLOCK and name not in ("a", "b", "i", "em", "span", "strong")):
            stack.append(node)
            self.open[name] += 1
        return at

    def _close(self, stack: list[int], name: str) -> None:
        limit = frozenset() if name in BLOCK else BLOCK  # an inline end tag ends nothing beyond its block
        self._close_to(stack, {name}, limit)

    def _close_to(self, stack: list[int], names: set[str], limit: frozenset) -> None:
        if not any(self.open[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                for node in reversed(stack[k:]):
                    self.open[self.tag[node]] -= 1
                    if self.tag[node] in BLOCK:
                        self.events.append((self.parent[node], None))
                del stack[k:]
                return
            if tag in limit:
                return


class Densities:
    """Characters and tags of every element, in all and in links, composite text densities and density sums.

    The density of an element is its characters per tag, lowered by the share of characters and tags in links (Sun et al., SIGIR 2011);
    its sum adds up the densities of its children. Every element counts, whatever it is called, but for those without running text.
    """

    def __init__(self, t: Tree):
        self.t, n = t, len(t.tag)
        self.chars, self.link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = in_link[t.parent[k]] or t.tag[k] == "a"
        self.texts: list[tuple[int, str | None]] = []
        for node, text in t.events:
            if text is None or t.silent[node]:
                self.texts.append((node, None))
                continue
            text = html.unescape(text) if "&" in text else text
            self.texts.append((node, text))
            size = len(text) - text.count(" ") if text != " " else 0
            self.chars[node] += size
            self.link_chars[node] += size if in_link[node] else 0
        for k in range(n - 1, 0, -1):
            if not t.silent[k]:
                p = t.parent[k]
                self.chars[p] += self.chars[k]
                self.link_chars[p] += self.link_chars[k]
                tags[p] += tags[k] + 1
                link_tags[p] += link_tags[k] + (t.tag[k] == "a")
        self.body = next((k for k in range(n) if t.tag[k] == "body"), 0)
        ratio = self.link_chars[self.body] / max(1, self.chars[self.body])

        def density(k: int) -> float:
            c, lc, tg, lt = self.chars[k], self.link_chars[k], max(1, tags[k]), max(1, link_tags[k])
            if not c:
                return 0.0
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            plain = math.log(max(1.0, c / max(1, lc) * tg / lt) + 1e-9)
            return c / tg * (plain / math.log(base) if base > 1 else plain)

        self.dense = [0.0 if t.silent[k] else density(k) for k in range(n)]
        self.sum = [0.0] * n
        for k in range(1, n):
            if t.tag[k] in BLOCK:
                self.sum[t.parent[k]] += self.dense[k]

    def path(self, k: int) -> list[int]:
        """An element and those around it, up to the body."""
        out = []
        while k >= 0:
            out.append(k)
            if k == self.body:
                break
            k = self.t.parent[k]
        return out

    def choose(self, declared: bool = True) -> int:
        """The element with the largest density sum; the first of equal ones. With `declared`, the page's only article (or else only main) is taken
        instead where
        that element lies around it or has little more."""
        t = self.t
        best = max(range(len(t.tag)), key=lambda k: (self.sum[k], -k))
        if not self.sum[best]:
            best = self.body if self.chars[self.body] else 0
        if declared:
            for name in ("article", "main"):
                named = [k for k, x in enumerate(t.tag) if x == name and self.chars[k]]
                if len(named) == 1 and named[0] not in self.path(best) and (best in self.path(named[0]) or best == 0 or self.sum[named[0]] >= DECLARED * self.sum[best]):
                    return named[0]
                if named:
                    break
        return best

    def keep(self, best: int) -> list[bool]:
        """Which elements' text belongs to the main text, given the chosen element.

        The smallest density on its path to the body is the threshold. Neighbours of the path join if they reach it, aren't mostly links and don't go
        by their name:
        paragraphs and the like, parts that have a good share of the chosen density sum, and headings before the path. Inside, parts go that are
        called something
        else and are mostly links or short beside the whole.
        """
        t, n = self.t, len(self.t.tag)
        path = self.path(best)
        threshold = min(self.dense[x] for x in path)
        above = set(path[1:])
        onto = dict(zip(path[1:], path, strict=False))  # the child that leads to the chosen element
        whole = self.chars[best]
        keep = [False] * n
        for k in range(n):
            up = t.parent[k]
            if t.silent[k] or k in above:
                continue
            linked = self.link_chars[k] * 2 >= max(1, self.chars[k])
            if k == best:
                keep[k] = True
            elif up >= 0 and keep[up]:
                keep[k] = not (t.against[k] and (linked and t.tag[k] not in HEADINGS or self.chars[k] <= t.against[k] * whole))
            elif up in above and t.tag[k] in BLOCK and not linked and not t.against[k]:
                title = t.tag[k] in HEADINGS and k < onto[up]
                joins = self.dense[k] >= threshold and (t.tag[k] in PROSE or self.sum[k] >= PART * self.sum[best] > 0)
                keep[k] = title or joins
        return keep


def main_text(page: str | None) -> str:
    """The text of the main part of a page, one line for each block; empty if there is none.

    Composite text density chooses the subtree (`Densities.choose`) and what belongs to it (`Densities.keep`). Of equal sums the first element in the
    page is taken.
    """
    d = Densities(Tree(page or ""))
    if not d.chars[0]:
        return ""
    keep = d.keep(d.choose())
    blocks, now = [], []
    for node, text in d.texts:
        if text is None:
            blocks.append(now)
            now = []
        elif keep[node]:
            now.append(text)
    lines = (" ".join("".join(b).split()) for b in [*blocks, now] if b)
    return "\n".join(x for x in lines if x)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without main text, give an empty text; a null id or url stays null; repeated rows stay; an empty table gives an empty
    result; further columns are ignored, whatever their names. Pages are parsed whole, however long, in one pass and without recursion; of
    subtrees with equal density sums the first is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for part in slices(b.column(2)) for p in part]
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"))
    kinds = [p.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return p.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(load(spark, sf_dir, "pages"))
