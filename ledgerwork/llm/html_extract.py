"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of elements (end tags that HTML lets authors leave out are supplied). Every node has
features: what its tag and the tokens of its class, id and role say, the same of its ancestors,
text, link and tag density of its subtree, depth, place among its siblings and how many of them are alike.
Boosted trees give each node the log-odds of being part of the article. Decoding picks the most
likely set of nodes in which no node is in without its parent: a decision for a node and against one of its
ancestors cannot both stand.

The trees are trained here, on pages made from layouts (articles in many wrappings, with menus, headers,
footers, sidebars, notices, adverts, forms and comments around and inside them) and on a bounded sample
of the given pages that mark their article with `article` or `main`.

Defined cases: null html is empty; a page without an article has the empty text; scripts, styles, templates and comments
are never text; an unknown tag is inline; a page cut off anywhere is read as far as it goes; repeated rows are
extracted each; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwork.llm import gbt, runtime

#: Pages of the table and made pages that the trees learn from, at most.
SAMPLE, MADE = 400, 600
#: Characters of the longest page that trees are made from; all pages are extracted.
LONGEST = 200_000
TREES, DEPTH, RATE, SEED = 40, 4, 0.3, 11

# Names of HTML elements by what they are.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea noscript template iframe svg".split())
BLOCK = set(
    "html body head title header footer nav main article section aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table "
    "thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset address details summary hgroup "
    "select option button label br hr center dialog menu search".split()
)
INLINE_OPEN = set("b i em strong a span u s small sub sup font code mark q cite abbr big tt label".split())
ENDS_P = BLOCK - {"br", "button", "label", "select", "option"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Kinds of tags and of attribute tokens that are features.
TAGS = [
    {"html", "body"}, {"head", "title", "meta", "link"}, {"article"}, {"main"}, {"section"}, {"div"}, {"p", "blockquote", "pre"},
    {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"a"}, {"nav"}, {"header"}, {"footer"}, {"aside"},
    {"form", "fieldset", "input", "button", "select", "option", "textarea", "label", "search"}, {"table", "thead", "tbody", "tr", "td", "th"},
    {"figure", "figcaption", "img"}, {"script", "style", "noscript", "template", "iframe", "svg", "dialog"},
]
TOKENS = [
    "article main content contentinfo story post entry body text articlebody maincontent",
    "nav navigation menu navbar breadcrumb breadcrumbs topbar toolbar tabs skip",
    "header masthead head top banner logo branding",
    "footer foot bottom copyright legal colophon",
    "sidebar side aside rail widget widgets complementary related recommended popular more trending",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner commercial teaser",
    "notice cookie cookies consent gdpr alert warning message popup modal overlay newsletter subscribe paywall",
    "comment comments reply replies discussion disqus thread respond responses",
    "form login signin signup search register contact",
    "share social sharing follow tags tag meta byline pagination pager author",
]
_KIND_OF_TAG = {tag: k for k, group in enumerate(TAGS) for tag in group}
_KINDS_OF_TOKEN: dict[str, list[int]] = {}
for _k, _group in enumerate(TOKENS):
    for _token in _group.split():
        _KINDS_OF_TOKEN.setdefault(_token, []).append(_k)

#: An attribute: a quote opens a value only behind the equals sign, and one that is never closed lasts to the end.
_ATTRIBUTE = r"""[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>|\Z)))?+"""
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:" + _ATTRIBUTE + r")*+)([\s/]*)>?", re.S
)
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Page:
    """The elements of a page in order: tag, attribute tokens, parent, and the runs of text with their element."""

    def __init__(self, source: str):
        self.tags, self.tokens, self.parents = ["html"], [()], [-1]
        self.texts: list[tuple[int, str]] = []  # (element, text); text None stands for a break
        self._read(source)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        tokens: set[int] = set()
        if attributes:
            for match in _NAMED.finditer(attributes):
                for token in _SPLIT.split((match[1] or match[2] or match[3] or "").lower()):
                    tokens.update(_KINDS_OF_TOKEN.get(token, ()))
        self.tags.append(tag)
        self.tokens.append(tuple(tokens))
        self.parents.append(parent)
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        stack, tags, at = [0], self.tags, 0
        size = len(source)
        while at < size:
            match = _TAG.search(source, at)
            start = match.start() if match else size
            if start > at:
                self.texts.append((stack[-1], source[at:start]))
            if not match:
                break
            at = match.end()
            if match[2]:
                tag = match[2].lower()
                if tag in BLOCK:
                    self.texts.append((stack[-1], None))
                if tag in ("html", "body", "head") and tag in (tags[k] for k in stack):
                    continue
                if tag in ENDS_P:
                    # a paragraph ends where a block begins, with what is open in it
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] == "p":
                            del stack[k:]
                            break
                        if tags[stack[k]] not in INLINE_OPEN:
                            break
                if tag in SIBLINGS:
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] in SIBLINGS[tag]:
                            del stack[k:]
                            break
                        if tags[stack[k]] in SCOPE[tag]:
                            break
                element = self._open(tag, match[3], stack[-1])
                # a slash closes foreign elements only, and not from inside a value
                if tag in RAW and not (tag == "svg" and match[4].endswith("/")):
                    end = re.compile(f"</{tag}[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else size
                elif tag not in VOID and tag not in RAW:
                    stack.append(element)
            elif match[1]:
                tag = match[1].lower()
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        del stack[k:]
                        break
                    # an inline end tag does not close a block
                    if tag in INLINE_OPEN and tags[stack[k]] in BLOCK:
                        break
                if tag in BLOCK:
                    self.texts.append((stack[-1], None))

    def features(self) -> np.ndarray:
        n = len(self.tags)
        parent = np.array(self.parents)
        own, links, words, marks = (np.zeros(n) for _ in range(4))
        for k, text in self.texts:
            if text:
                own[k] += len(text)
                words[k] += text.count(" ") + 1
                marks[k] += text.count(".") + text.count(",")
        kind = np.array([_KIND_OF_TAG.get(tag, len(TAGS)) for tag in self.tags])
        links[kind == _KIND_OF_TAG["a"]] = own[kind == _KIND_OF_TAG["a"]]
        sums = np.column_stack((own, links, words, marks, np.ones(n)))
        for k in range(n - 1, 0, -1):  # children come behind their parents
            sums[parent[k]] += sums[k]
        tag, token = np.zeros((n, len(TAGS) + 1)), np.zeros((n, len(TOKENS)))
        tag[np.arange(n), kind] = 1
        for k, tokens in enumerate(self.tokens):
            token[k, list(tokens)] = 1
        above_tag, above_token, depth = np.zeros_like(tag), np.zeros_like(token), np.zeros(n)
        index, alike = np.zeros(n), np.zeros(n)
        seen: dict[int, int] = {}
        same: dict[tuple[int, int], int] = {}
        for k in range(1, n):
            p = parent[k]
            above_tag[k] = np.maximum(above_tag[p], tag[p])
            above_token[k] = np.maximum(above_token[p], token[p])
            depth[k] = depth[p] + 1
            index[k] = seen[p] = seen.get(p, -1) + 1
            same[p, kind[k]] = same.get((p, kind[k]), 0) + 1
        siblings = np.array([0, *(seen[p] for p in self.parents[1:])])
        alike[1:] = [same[p, x] for p, x in zip(self.parents[1:], kind[1:].tolist(), strict=True)]
        text, link, word, mark, tags_in = sums.T
        whole = max(text[0], 1)
        dense = np.column_stack(
            (
                np.log1p(own), np.log1p(text), text / whole, link / np.maximum(text, 1), text / tags_in, word / tags_in,
                mark / np.maximum(word, 1), np.log1p(tags_in), depth, index, siblings, index / np.maximum(siblings, 1),
                alike / np.maximum(siblings + 1, 1), np.arange(n) / n, text[np.maximum(parent, 0)] / whole,
                link[np.maximum(parent, 0)] / np.maximum(text[np.maximum(parent, 0)], 1),
            )
        )
        return np.hstack((tag, token, above_tag, above_token, dense))

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """The most likely set of nodes such that the parent of each is in it (the root always is)."""
        worth = odds.tolist()
        worth[0] = 0.0
        for k in range(len(worth) - 1, 0, -1):
            if worth[k] > 0:
                worth[self.parents[k]] += worth[k]
        chosen = [True] * len(worth)
        for k in range(1, len(worth)):
            chosen[k] = chosen[self.parents[k]] and worth[k] > 0
        return np.array(chosen)

    def text(self, chosen: np.ndarray) -> str:
        """The text of the chosen nodes: white space runs become one space, blocks are apart by one."""
        parts = [" " if text is None else html.unescape(text) for k, text in self.texts if text is None or chosen[k]]
        return " ".join("".join(parts).split())


def _wrappings(draw: random.Random) -> str:
    """A made page; what belongs to the article is marked by the attribute `data-in`."""
    syllables = "an en ti re st on ou la de le und ein que ción".split()

    def words(low: int, high: int) -> str:
        text = " ".join("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(draw.randint(low, high)))
        return text.capitalize() + draw.choice((".", ".", "", ", " + draw.choice(syllables) + "."))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 2)}</a></li>' for k in range(n))

    def named(tags: str, *names: str) -> tuple[str, str]:
        tag = draw.choice(tags.split())
        attribute = draw.choice(("class", "class", "id"))
        return f'<{tag} {attribute}="{draw.choice(names)}">', f"</{tag}>"

    def outside(kind: str) -> str:
        if kind == "menu":
            o, c = draw.choice((("<nav>", "</nav>"), named("div ul nav", "menu", "main-nav", "navbar", "navigation", "breadcrumb")))
            return f"{o}<ul>{links(draw.randint(2, 8))}</ul>{c}"
        if kind == "header":
            o, c = draw.choice((("<header>", "</header>"), named("div header", "header", "masthead", "site-header", "top-bar")))
            return f"{o}<a href='/'>{words(1, 3)}</a><p>{words(2, 8)}</p>{c}"
        if kind == "footer":
            o, c = draw.choice((("<footer>", "</footer>"), named("div footer", "footer", "site-footer", "copyright")))
            return f"{o}&copy; {words(1, 4)} &middot; {words(3, 15)}{c}"
        if kind == "sidebar":
            o, c = draw.choice((("<aside>", "</aside>"), named("div aside section", "sidebar", "side", "widget", "related", "rail")))
            return f"{o}<h3>{words(1, 3)}</h3>" + draw.choice((f"<ul>{links(3)}</ul>", f"<p>{words(5, 40)}</p>")) + c
        if kind == "advert":
            o, c = named("div section aside p", "ad", "ads", "advert", "sponsored", "promo", "ad-banner")
            return f"{o}{words(3, 30)}{c}"
        if kind == "notice":
            o, c = named("div section p", "notice", "cookie-notice", "cookie-banner", "alert", "newsletter", "consent")
            return f"{o}<p>{words(4, 25)}</p><button>{words(1, 2)}</button>{c}"
        if kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name='q'><button>{words(1, 1)}</button>"
            return draw.choice((f"<form>{inner}</form>", f'<div class="login">{inner}</div>', f'<form class="search">{inner}</form>'))
        o, c = named("div section ol", "comments", "comment-list", "discussion", "replies")
        one = "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{words(4, 40)}</p></div>' for _ in range(draw.randint(1, 5)))
        return f"{o}<h3>{words(1, 2)}</h3>{one}{c}"

    kinds = "menu header footer sidebar advert notice form comments".split()

    def article() -> str:
        blocks = [f"<h1 data-in>{words(2, 9)}</h1>"] if draw.random() < 0.8 else []
        for _ in range(draw.randint(1, 9)):
            blocks.append(
                draw.choice(
                    (
                        f"<p data-in>{words(4, 70)}</p>", f"<p data-in>{words(10, 90)}</p>", f"<p data-in><b data-in>{words(3, 20)}<br>", f"<p data-in>{words(8, 60)} <a data-in href='/x'>{words(1, 3)}</a> {words(1, 9)}</p>",
                        f"<h2 data-in>{words(2, 6)}</h2>", f"<ul data-in><li data-in>{words(2, 12)}</li><li data-in>{words(2, 12)}</li></ul>", f"<blockquote data-in><p data-in>{words(5, 40)}</p></blockquote>",
                        f"<table data-in><tr data-in><td data-in>{words(1, 4)}</td><td data-in>{words(1, 4)}</td></tr></table>", f"<pre data-in>{words(3, 20)}</pre>", f"<div data-in>{words(10, 60)}</div>", f"<p data-in>{words(1, 4)}</p>",
                    )
                )
            )
            if draw.random() < 0.12:
                blocks.append(outside(draw.choice(("advert", "notice", "sidebar", "form", "comments"))))
        body = "".join(blocks)
        tag, attribute = draw.choice((("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("section", ' class="article-body"'), ("div", ' class="entry"')))
        if draw.random() < 0.2:
            body = f"<div data-in>{body}</div>"
        return f"<{tag} data-in{attribute}>{body}</{tag}>"

    before = [outside(k) for k in kinds if draw.random() < (0.5 if k in ("menu", "header", "advert", "notice") else 0.15)]
    after = [outside(k) for k in kinds if draw.random() < (0.5 if k in ("footer", "sidebar", "comments") else 0.15)]
    draw.shuffle(before)
    middle = article() if draw.random() < 0.95 else ""
    if draw.random() < 0.3:
        middle = f'<div data-in class="{draw.choice(("wrap", "container", "page", "row"))}">{middle}{outside(draw.choice(kinds))}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body data-in>{''.join(before)}{middle}{''.join(after)}</body></html>"


def _made_pages() -> tuple[list[np.ndarray], list[np.ndarray]]:
    draw = random.Random(SEED)
    xs, ys = [], []
    for _ in range(MADE):
        source = _wrappings(draw)
        marked = Page(source)
        # elements are opened in the order of their tags, so the marks can be read off the source
        marks = [bool(m[3] and "data-in" in m[3]) for m in _TAG.finditer(source) if m[2]]
        tags = [m[2].lower() for m in _TAG.finditer(source) if m[2]]
        found = [mark for mark, tag in zip(marks, tags, strict=True) if tag != "html"]
        if len(found) == len(marked.tags) - 1:
            xs.append(marked.features()[1:])
            ys.append(np.array(found, float))
    return xs, ys


def _own_labels(page: Page) -> np.ndarray | None:
    """Of a page that marks its article: what is inside it, and what leads to it."""
    inside = np.zeros(len(page.tags), bool)
    found = False
    for k, tag in enumerate(page.tags[1:], 1):
        if inside[page.parents[k]]:
            inside[k] = not (set(page.tokens[k]) & set(range(1, 9))) and tag not in RAW | {"nav", "aside", "form", "header", "footer"}
        elif tag in ("article", "main"):
            inside[k] = found = True
    if not found:
        return None
    leads = inside.copy()
    for k in range(len(page.tags) - 1, 0, -1):
        if leads[k]:
            leads[page.parents[k]] = True
    return leads.astype(float)


def fit(pages: DataFrame) -> gbt.Trees:
    """Trees from made pages and a bounded sample of the given ones, drawn by a hash of the page."""
    xs, ys = _made_pages()
    # hashes first, so that no task sends pages that are not chosen; equal pages are one
    short = pages.select("html", F.xxhash64("html").alias("hash")).where(F.length("html") <= LONGEST)
    chosen = [r["hash"] for r in short.select("hash").distinct().orderBy("hash").limit(SAMPLE).collect()]
    rows = short.where(F.col("hash").isin(chosen)).groupBy("hash").agg(F.min("html").alias("html")).orderBy("hash")
    for row in rows.collect():
        page = Page(row["html"])
        label = _own_labels(page)
        if label is not None:
            xs.append(page.features()[1:])
            ys.append(label[1:])
    return gbt.train(np.vstack(xs), np.concatenate(ys), TREES, DEPTH, RATE)


def extract(pages: DataFrame, trees: gbt.Trees, name: str = "text") -> DataFrame:
    """The rows with a further column `name` (with underscores if it is taken), the page's main text."""
    name = runtime.free_name(name, pages)
    schema = T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "html", 1 << 20):
            read = [Page(source or "") for source in batch.column("html").to_pylist()]
            odds = trees.log_odds(np.vstack([page.features() for page in read]))
            texts, at = [], 0
            for page in read:
                n = len(page.tags)
                texts.append(page.text(page.decode(odds[at : at + n])))
                at += n
            yield batch.append_column(name, pa.array(texts, pa.string()))

    return pages.mapInArrow(run, schema)
