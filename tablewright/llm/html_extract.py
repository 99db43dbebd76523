"""Main text of web pages by the maximum-scoring subsequence of words and tags.

Words score positive, tags negative.  The weights come from labelled pages, those that mark their content with an article or
main element: the log-odds of a tag, or of a word in a given kind of element, inside against outside the marked content.  One
scan finds the contiguous run of tokens with the largest sum.  Where that run lies in marked content, it grows to the whole
element.  Elements that hold no article text by what they are (navigation, forms, scripts) or are called (class, id, role)
never score and are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import col

#: Names of HTML elements by what they mean for text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
APART = frozenset("head nav footer aside form button select option datalist fieldset label input dialog menu object applet audio video canvas map".split()) | RAW
MARKED = frozenset(("article", "main"))
CALLED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner sidebar sidebars aside "
    "menu menus nav navbar navigation breadcrumb breadcrumbs topbar footer masthead cookie cookies consent gdpr notice notices alert alerts popup "
    "modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments "
    "commentlist respond replies disqus widget widgets toolbar pagination pager paging skip copyright legal disclaimer contentinfo complementary "
    "dialog tracking".split()
)

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?/][^>]*+>""", re.S
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


def _set_apart(name: str, attributes: str, marked: bool) -> bool:
    if name in APART:
        return True
    if name == "header":
        return not marked  # a page's header; an article's own one holds its title
    if "=" not in attributes or name in ("html", "body"):
        return False
    for kind, a, b, c in _NAMED.findall(attributes):
        words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
        if not CALLED.isdisjoint(words):
            return True
        if not marked and ("header" in words or kind.lower() == "role" and "form" in words):
            return True
    return False


class Page:
    """Tokens of a page: kinds, texts and word counts, whether a token lies in marked content or in what is set apart."""

    def __init__(self, source: str):
        self.kind: list[str] = []  # "<p", "</p" or the kind of words: "words", "link"
        self.text: list[str | None] = []
        self.count: list[int] = []
        self.marked: list[int] = []  # number of the outermost marked element, -1 outside
        self.apart: list[bool] = []
        stack: list[tuple[str, bool, bool, bool]] = []  # name, set apart, marked, link
        state = [0, 0, 0]
        elements = -1
        at = 0

        def words(piece: str) -> None:
            n = len(piece.split())
            if n or piece:
                self._add("link" if state[2] else "words", piece, n, elements if state[1] else -1, state[0] > 0)

        def close(depth: int) -> None:
            for _, apart, marked, link in stack[depth:]:
                state[0] -= apart
                state[1] -= marked
                state[2] -= link
            del stack[depth:]

        while (found := _TAG.search(source, at)) is not None:
            if found.start() > at:
                words(source[at : found.start()])
            at = found.end()
            closing, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if closing:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    close(depth)
                self._add("</" + name, None, 0, elements if state[1] else -1, state[0] > 0)
                continue
            if name in ("p", "li") and stack and stack[-1][0] == name:
                close(len(stack) - 1)
            marked = name in MARKED and not state[0]
            apart = _set_apart(name, attributes, state[1] > 0)
            marked = marked and not apart
            if marked and not state[1]:
                elements += 1
            self._add("<" + name, None, 0, elements if state[1] else -1, state[0] > 0 or apart)
            if name in RAW and not (name in ("svg", "math") and attributes.endswith("/")):  # foreign elements may close themselves
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif name not in VOID and not attributes.endswith("/"):
                stack.append((name, apart, marked, name == "a"))
                state[0] += apart
                state[1] += marked
                state[2] += name == "a"
        if at < len(source):
            words(source[at:])

    def _add(self, kind: str, text: str | None, count: int, marked: int, apart: bool) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.count.append(count)
        self.marked.append(marked)
        self.apart.append(apart)

    def blocks(self, keep: np.ndarray) -> list[str]:
        """Texts of the kept tokens, cut where a block element begins or ends."""
        found, run = [], []
        for kind, text, kept in zip(self.kind, self.text, keep.tolist(), strict=True):
            if text is not None:
                if kept:
                    run.append(text)
                continue
            name = kind.lstrip("</")
            if name == "br":
                run.append(" ")
            elif name not in INLINE and run:
                found.append(run)
                run = []
        found.append(run)
        joined = (" ".join(html.unescape("".join(r)).split()) for r in found)
        return [b for b in joined if b]


def _feature(kind: str) -> str:
    name = kind.lstrip("</")
    known = name in BLOCKS or name in INLINE or name in APART or name in VOID
    return kind if known or kind in ("words", "link") else "<other"


def learn_weights(pages: DataFrame, source: str = "html") -> dict[str, float]:
    """Weights of tags and words from all pages that mark their content; empty without such pages.

    The result has at most two entries for each known element name."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for value in batch["html"]:
                page = Page(value or "")
                if max(page.marked, default=-1) < 0:
                    continue
                for kind, n, marked, apart in zip(page.kind, page.count, page.marked, page.apart, strict=True):
                    into = inside if marked >= 0 and not apart else outside
                    into[_feature(kind)] += n if kind in ("words", "link") else 1
        keys = sorted({*inside, *outside})
        if keys:
            yield pd.DataFrame({"key": keys, "a": [inside[k] for k in keys], "b": [outside[k] for k in keys]})

    rows = pages.select(col(source).cast("string").alias("html")).mapInPandas(count, "key string, a long, b long")
    found = rows.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    odds = {r["key"]: float(np.log((r["a"] + 0.5) / (r["b"] + 0.5))) for r in found}
    return {k: max(v, 0.1) if k in ("words", "link") else min(v, -0.1) for k, v in odds.items()}


#: Weights where no page marks its content.
PLAIN = {"words": 1.0, "link": 0.1, "<p": -0.1, "</p": -0.1, "<br": -0.1, "<h1": -0.1, "</h1": -0.1, "<a": -4.0, "</a": -4.0, "<li": -4.0, "</li": -4.0}


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """(from, to) of the contiguous run with the largest sum, the first and shortest of equal ones; (0, 0) if none is positive."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    low = np.minimum.accumulate(total)
    gain = total - low
    end = int(gain.argmax())
    if gain[end] <= 0:
        return 0, 0
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best content region, joined by a blank line; empty if the page has none."""
    page = Page(source or "")
    if not page.kind:
        return ""
    apart = np.array(page.apart)
    marked = np.array(page.marked)
    weight = np.array([weights.get(_feature(k), PLAIN.get(k, -2.0)) for k in page.kind])
    count = np.array(page.count, float)
    is_text = np.array([t is not None for t in page.text])
    scores = np.where(is_text, np.where(apart, 0.0, count * weight), weight)
    start, end = best_run(scores)
    inside = np.zeros(len(scores), bool)
    inside[start:end] = True
    hit = np.unique(marked[inside & is_text & (count > 0) & ~apart])
    hit = hit[hit >= 0]
    if len(hit):
        inside = np.isin(marked, hit)
    return "\n\n".join(page.blocks(inside & ~apart))


def extract(df: DataFrame, weights: dict[str, float], source: str = "html", name: str = "text") -> DataFrame:
    """All rows with their main text.  Null or empty pages, and pages without content, get an empty text.  No shuffle.

    A column of ``df`` called ``name`` is replaced."""

    @F.pandas_udf("string")
    def found(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weights) for p in pages], dtype=object)

    return df.withColumn(name, found(col(source).cast("string")))
