"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score by the elements they stand in and tags cost, by weights counted on labelled
pages: those that mark their content themselves (an article or main element). One linear scan finds the contiguous region of
the largest sum; its blocks, less those in elements that weigh below zero, are the main text. Names that no labelled page
shows have fixed first weights: those of menus, notices, adverts, forms, comments and the like are low. Nothing is cut out by
name before the scan but what a browser never shows as text: scripts, styles and the head.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled pages to learn from, at most; a name counts as shown by this many of its words or tags.
SAMPLE, SHOWN = 600, 20
#: A word scores from minus to plus one: NEW_WORD, or NEW_LINK in a link, plus what its elements weigh, each from -LEVEL to LEVEL by its share of content.
NEW_WORD, NEW_LINK, LEVEL = 0.8, -0.3, 4.0
#: What an article or main element weighs, and one of a name that stands for something else.
CONTENT, OTHER = 2.0, -4.0
#: A tag costs from the first to the second by its share outside of content, or as the third if it is new or the name of a mere container.
TAG_IN, TAG_OUT, NEW_TAG = 0.05, 20.0, 0.2

RAW = {"script", "style", "noscript", "template", "textarea", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = RAW | {"head", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
LABELLED = {"article", "main"}
#: Containers and text elements, whose name says nothing about what they stand for.
PLAIN = {"html", "body", "div", "section", "center", "table", "tbody", "thead", "tfoot", "caption", "tr", "td", "th", "ul", "ol", "li", "dl", "dt", "dd", "p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "figcaption", "address", "fieldset", "details", "summary"}
#: Elements that by their definition hold no part of an article.
ASIDE = {"nav", "footer", "aside", "form", "menu", "button", "select", "svg", "canvas", "object", "audio", "video", "dialog", "map", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Words of class and id names that stand for something else than the article; a name counts if all its words are of these or of PARTS.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice popup modal overlay sidebar side widget "
    "widgets menu nav navbar navigation breadcrumb breadcrumbs toolbar share sharing social related recommended recommendations comment comments commentlist reply replies respond responses disqus "
    "feedback discussion newsletter subscribe subscription signup login masthead footer copyright pagination pager skip tags topbar".split()
)
PARTS = frozenset("area bar block body bottom box button buttons column container content form group header holder inner item items left link links list main outer page panel post posts reader readers right section site slot top user users wrap wrapper".split())
P_CLOSERS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
P_KEEPERS = ("div", "td", "article", "section", "li", "blockquote")
BARRIERS = ("table", "article", "main", "body")

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Names that tell what a wrapper has or lacks, not what it is.
_STATE = re.compile(r"(?<![a-z0-9])(?:has|with|without|no)[-_]\S*", re.I)


@dataclass
class Page:
    """Elements (parent, name, features, what they hold that is labelled), blocks of text by element, and the sequence of items.

    An item is (block, element, in a link, words), with block -1 for a tag of the element.
    """

    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: ["body"])
    features: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    inside: list[bool] = field(default_factory=lambda: [False])
    around: list[bool] = field(default_factory=lambda: [True])
    blocks: list[list[str]] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)
    items: list[tuple[int, int, bool, int]] = field(default_factory=list)


def _features(name: str, attributes: str) -> tuple[str, ...]:
    """An element's features: ``t`` and its name, ``n`` and each class or id name, ``r`` and its role, ``hidden``."""
    found = [f"t {name}"] if name not in INLINE and name not in PLAIN else []
    if name in ("html", "body") or not attributes.strip():
        return tuple(found)
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            found += [f"n {x}" for x in _STATE.sub(" ", value).split()]
        elif key == "role":
            found.append(f"r {value.lower()}")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value.lower()):
            found.append("hidden")
    return tuple(found)


def parse(source: str) -> Page:
    """Linear in the page's length: open elements are found by name, not by walking up."""
    page, at, n = Page(), 0, len(source)
    stack: list[int] = [0]  # open elements
    where: dict[str, list[int]] = {}  # by name, the places in the stack
    fresh, links, unseen = True, 0, 0
    blocks_of = [0]  # by element, its nearest element that is a block
    text: list[str] = []

    def last(name: str) -> int:
        places = where.get(name)
        return places[-1] if places else -1

    def flush() -> None:
        """Text since the last tag joins its block; spaces at its ends part words from the neighbours'."""
        nonlocal fresh
        if unseen:
            text.clear()
            return
        whole = html.unescape("".join(text))
        text.clear()
        words = len(whole.split())
        if not whole or not words and (fresh or not page.blocks):
            return
        if fresh and words:
            page.blocks.append([])
            page.owners.append(blocks_of[stack[-1]])
            fresh = False
        page.blocks[-1].append(whole)
        if words:
            page.items.append((len(page.blocks) - 1, stack[-1], links > 0, words))

    def close(k: int) -> None:
        nonlocal links, unseen
        for e in stack[k:]:
            name = page.names[e]
            where[name].pop()
            links -= name == "a"
            unseen -= name in UNSEEN
        del stack[k:]

    while at < n:
        m = _PIECE.search(source, at)
        if not m:
            text.append(source[at:])
            break
        text.append(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        flush()
        name, inline = m[2].lower(), m[2].lower() in INLINE
        if name == "br":
            if not fresh and not unseen:
                page.blocks[-1].append(" ")
            continue
        if m[1]:
            k = last(name)
            if k > (max(map(last, BARRIERS)) if inline else 0) or k > 0 and not inline:
                if not unseen and not inline:
                    page.items.append((-1, stack[k], False, 0))
                close(k)
        else:
            if name in P_CLOSERS:
                k = last("p")
                if k > max(map(last, P_KEEPERS)):
                    close(k)
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and page.names[stack[-1]] == name:
                close(len(stack) - 1)
            if name in VOID or m[3].endswith("/") and name not in RAW:
                fresh = fresh or not inline
                continue
            up, e = stack[-1], len(page.parents)
            page.parents.append(up)
            page.names.append(name)
            page.features.append(_features(name, m[3]))
            page.inside.append(page.inside[up] or name in LABELLED)
            page.around.append(False)
            blocks_of.append(blocks_of[up] if inline else e)
            if name in LABELLED:
                while up >= 0 and not page.around[up]:  # each element is marked once
                    page.around[up] = True
                    up = page.parents[up]
            where.setdefault(name, []).append(len(stack))
            stack.append(e)
            links += name == "a"
            unseen += name in UNSEEN
            if name in RAW or name == "title":
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                close(len(stack) - 1)
            elif not unseen and not inline:
                page.items.append((-1, e, False, 0))
        if not inline:
            fresh = True
    flush()
    return page


def evidence(page: Page) -> tuple[Counter, Counter]:
    """Words by (feature, in content), and tags by (name, in content), of a page with labelled content.

    Outside of it only the outermost element counts, which what it holds merely repeats: the links of a menu are there because it is a menu.
    """
    held = [0] * len(page.parents)
    tags, words = Counter(), Counter()
    outer = [-1] * len(page.parents)
    for e in range(1, len(page.parents)):
        up = page.parents[e]
        outer[e] = outer[up] if outer[up] >= 0 else e if not page.around[e] and not page.inside[e] and page.names[e] not in ("html", "body") else -1
    for block, e, _, n in page.items:
        held[e] += n
        if block < 0 and (page.inside[e] or outer[e] in (-1, e)):
            tags[page.names[e], page.inside[e]] += page.names[e] not in LABELLED
    for e in range(len(page.parents) - 1, 0, -1):
        held[page.parents[e]] += held[e]
        if page.inside[e] and page.names[e] not in LABELLED or outer[e] == e:
            for f in page.features[e]:
                words[f, page.inside[e]] += held[e]
    return words, tags


@dataclass(frozen=True)
class Weights:
    """What elements of a feature weigh and tags of a name cost, as labelled pages show them."""

    features: dict[str, float]
    tags: dict[str, float]

    def of(self, features: tuple[str, ...], inside: bool, hints: bool = True) -> float:
        """Of an element; within labelled content an element's name weighs what it does by definition."""
        total = 0.0
        for f in features:
            if f in self.features and not (inside and f[:2] == "t "):
                total += self.features[f]
            elif hints:
                total += first_weight(f, inside)
        return max(OTHER, min(CONTENT, total))


def first_weight(feature: str, inside: bool) -> float:
    """Of a feature that no labelled page shows."""
    kind, _, name = feature.partition(" ")
    if kind == "t":
        return OTHER if name in ASIDE or name == "header" and not inside else 0.0
    if kind == "n":
        words = [w.lower() for w in _WORDS.findall(name)]
        hint = not HINTS.isdisjoint(words) and all(w in HINTS or w in PARTS or w.isdigit() for w in words)
        return OTHER if hint or name.lower() in ("header", "site-header", "page-header") and not inside else 0.0
    return OTHER if kind == "hidden" or name in ROLES else 0.0


NO_WEIGHTS = Weights({}, {})


def learn(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from ``pages`` (html): the first ``sample`` different ones, by a hash, that have an article or main element, of any length; their counts are summed by Spark. Without any, the first weights hold."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("html", F.xxhash64("html").alias("h"))
    last = [r.h for r in marked.select("h").distinct().orderBy("h").limit(sample).collect()]  # hashes alone, so that a task sends little
    if not last:
        return NO_WEIGHTS

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, tags = Counter(), Counter()
            for x in b["html"]:
                w, t = evidence(parse(x))
                words += w
                tags += t
            rows = [("word", *k, n) for k, n in words.items()] + [("tag", *k, n) for k, n in tags.items()]
            yield pd.DataFrame(rows, columns=["kind", "name", "inside", "n"])

    of_pages = marked.where(F.col("h") <= last[-1]).dropDuplicates(["h"]).select("html").mapInPandas(counted, "kind string, name string, inside boolean, n long")
    sums = of_pages.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inner")).where(F.col("n") >= SHOWN).collect()
    share = {(r.kind, r.name): r.inner / r.n for r in sums}
    return Weights(
        {name: LEVEL * (2 * s - 1) for (kind, name), s in share.items() if kind == "word"},
        {name: -TAG_IN - TAG_OUT * (1 - s) for (kind, name), s in share.items() if kind == "tag" and name not in PLAIN},
    )


def best_region(scores: list[float]) -> tuple[int, int]:
    """Half-open bounds of the contiguous run of the largest sum, the first and longest of equals; (0, 0) if no sum is above zero."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and bounds[1] and bounds[0] == start:
            best, bounds = total, (start, i + 1)
    return bounds


def scored(page: Page, weights: Weights, hints: bool = True) -> tuple[list[float], list[float]]:
    """What each element weighs with those around it, and the score of each item.

    What is around the labelled element of the most words weighs nothing. Within labelled content, words that stand for something else count 0, so that
    they part nothing, and tags cost what they do in content. Where labelled content is most of a page, words beside it count as what stands beside content in all labelled pages.
    """
    size = [0] * len(page.parents)
    for block, e, _, n in page.items:
        size[e] += n
    for e in range(len(page.parents) - 1, 0, -1):
        size[page.parents[e]] += size[e]
    tops = [e for e in range(1, len(page.parents)) if page.names[e] in LABELLED and not page.inside[page.parents[e]]]
    around, at = {0}, max(tops, key=size.__getitem__, default=0)
    while at > 0:
        at = page.parents[at]
        around.add(at)
    level = [0.0] * len(page.parents)
    for e in range(1, len(page.parents)):
        up = page.parents[e]
        if page.names[e] in LABELLED:
            level[e] = level[up] + (0.0 if page.inside[up] else CONTENT)
        else:
            level[e] = level[up] + (0.0 if e in around else weights.of(page.features[e], page.inside[e], hints))
    within, beside = (sum(n for _, e, _, n in page.items if page.inside[e] == side and level[e] >= 0) for side in (True, False))
    apart = OTHER if within > beside else 0.0
    scores = []
    for block, e, link, n in page.items:
        if block < 0:
            scores.append(-TAG_IN if page.inside[e] else weights.tags.get(page.names[e], -NEW_TAG))
        elif page.inside[e] and level[e] < 0:
            scores.append(0.0)
        else:
            scores.append(n * max(-1.0, min(1.0, (NEW_LINK if link else NEW_WORD) + level[e] + (0.0 if page.inside[e] else apart))))
    return level, scores


def main_text(source: str | None, weights: Weights = NO_WEIGHTS) -> str:
    """Blocks of the best region in page order, one to a line, less those whose elements weigh below zero; empty for a page without words.

    A page of which nothing would be left is read again by what labelled pages show alone.
    """
    if not source:
        return ""
    page = parse(source)
    for hints in (True, False):
        level, scores = scored(page, weights, hints)
        lo, hi = best_region(scores)
        chosen = [x[0] for x in page.items[lo:hi] if x[0] >= 0]
        if chosen:
            kept = [b for b, e in zip(page.blocks[chosen[0] : chosen[-1] + 1], page.owners[chosen[0] : chosen[-1] + 1], strict=True) if level[e] >= 0]
            return "\n".join(t for t in (" ".join("".join(b).split()) for b in kept) if t)
    return ""


def extract(column: Column, weights: Weights) -> Column:
    """Main text of a column of HTML; null and empty pages, and those without words, give empty texts, equal pages equal ones. Time is linear in a page's length, however its tags nest."""

    def each(pages: pd.Series) -> pd.Series:
        known: dict = {}
        for x in pages:
            if x not in known:
                known[x] = main_text(x, weights)
        return pd.Series([known[x] for x in pages], dtype=object)

    each.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, "string")(column)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extract(F.col("html"), learn(pages)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
