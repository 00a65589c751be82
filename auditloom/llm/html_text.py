"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks. Each block is described by its words, its link
density, the same of its neighbours and its place (inside an article, inside a menu, footer, form or a
container whose class or id names one of these). A decision tree, grown here from the small labelled
table below, tells article text from the rest. Tags are read in one pass of linear time; markup that is broken off or
never closed does no harm, since only the containers on the way are kept on a stack. Elements without
text of the page go with what is in them only if they are closed; a head or title also ends at the body
or the first block. Only an open comment, script or style takes the rest of the page, as in browsers.

A container named after another part puts its blocks outside, unless the name only says how the page is
laid out (``with-sidebar``). A main element inside outweighs such a name, and so does an article where
no other article of the page is free of them.

Defined results: null or empty html, or a page without article text, gives an empty text; pages are
independent, so repeated rows and null ids or urls pass through; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without text of the page, block-level elements, containers, names of other parts.
CODE = "script style"
RAW = "noscript template svg iframe object canvas textarea select button head title video audio"
BLOCK = ("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
         "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split()
OUTSIDE = set("nav footer aside form menu dialog fieldset legend label address".split())
MAIN_NAMES = set("article main content post story entry body text".split())
OTHER_NAMES = (r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|menus?|nav\w*|breadcrumbs?|sidebar\w*|footer\w*|masthead|topbar|toolbar|cookies?\w*|"
               r"consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|shar\w+|social|related|recommend\w*|comments?|commentlist|disqus|repl(?:y|ies)|"
               r"respond|log-?in|sign-?up|widgets?|paginat\w*|pager|copyright|search\w*|skip)(?:$|[^a-z])")
LAYOUT_NAMES = set("with without has have no not hide show layout column columns template category tag format type status open closed enabled disabled".split())

# Every repetition below is possessive or ends at the end of the page, so none is tried again from the same place.
_CODE = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(CODE.split()) + r")(?=[\s/>])[^>]*+(?:\Z|(?<=/)>|>.*?(?:</\1\s*>|\Z))", re.S | re.I)
_RAW = re.compile(r"<(/?)(" + "|".join(RAW.split()) + r")(?=[\s/>])[^>]*+(?:>|\Z)", re.I)
_BODY = re.compile(r"<(?:" + "|".join(set(BLOCK) - {"html"}) + r")(?=[\s/>])", re.I)
_TAG = re.compile(r"""(<[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[a-zA-Z/!?][^>]*+(?:>|\Z))""")
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?:[\s>=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_OTHER = re.compile(OTHER_NAMES, re.I)
_BLOCKS, _CONTAINERS = set(BLOCK), set(BLOCK) - set("p hr li td th tr dd dt h1 h2 h3 h4 h5 h6 html body".split())
VOID = set("hr br img input meta link".split())

#: place: 1 in an article, 0 the page marks none, -1 not in the page's article. outside: in a part of another purpose.
FEATURES = ("place", "outside", "words", "links", "words_before", "links_before", "words_after", "links_after", "kind")
#: kind: 1 paragraph, 2 heading, 3 list item or cell, 0 other.
KINDS = {"p": 1, "blockquote": 1, "pre": 1, **{f"h{n}": 2 for n in range(1, 7)}, "li": 3, "td": 3, "th": 3, "dd": 3, "dt": 3}

#: Labelled table: the features in the order above (link densities in percent), then 1 for article text.
TABLE = """
1 0 12 0 0 0 85 0 2 1
1 0 85 0 12 0 40 0 1 1
1 0 40 0 85 0 1 0 1 1
1 0 1 0 40 0 60 0 1 1
1 0 3 0 60 0 22 0 1 1
1 0 22 0 3 0 9 0 0 1
1 0 60 10 22 0 15 0 1 1
1 0 15 0 60 10 5 0 3 1
1 0 5 0 15 0 7 100 3 1
1 0 8 100 5 0 30 0 1 1
1 0 30 50 8 100 12 0 1 1
1 0 2 100 30 0 2 100 3 1
1 0 7 0 2 100 90 0 2 1
1 0 90 0 7 0 0 0 1 1
1 0 120 2 3 0 80 0 1 1
1 0 6 0 120 2 14 0 0 1
-1 1 1 100 0 0 1 100 3 0
-1 1 1 100 1 100 1 100 3 0
-1 1 1 100 1 100 9 0 3 0
-1 1 9 0 1 100 12 0 0 0
-1 1 12 0 1 100 30 0 0 0
-1 1 10 0 80 0 0 0 0 0
-1 1 25 0 80 0 0 0 0 0
-1 1 60 0 20 0 25 0 1 0
-1 1 40 0 60 0 40 0 1 0
1 1 18 0 40 0 12 0 0 0
1 1 30 0 90 0 22 0 1 0
1 1 75 0 30 0 10 0 1 0
1 1 5 0 75 0 8 100 2 0
1 1 4 100 5 0 4 100 3 0
1 1 8 0 0 0 4 0 0 0
1 1 2 0 8 0 3 0 2 0
-1 0 14 0 9 0 20 0 0 0
-1 0 20 0 14 0 12 0 1 0
-1 0 45 0 9 0 12 0 1 0
-1 0 3 0 10 0 45 0 2 0
-1 0 6 100 3 0 6 100 3 0
-1 0 80 5 6 100 20 0 1 0
-1 0 2 0 0 0 5 100 0 0
0 0 11 0 0 0 70 0 2 1
0 0 70 0 11 0 55 3 1 1
0 0 55 3 70 0 24 0 1 1
0 0 24 0 55 3 4 0 1 1
0 0 4 0 24 0 66 0 1 1
0 0 66 0 4 0 100 0 0 1
0 0 100 0 66 0 7 0 1 1
0 0 7 0 100 0 33 0 2 1
0 0 33 12 7 0 18 0 1 1
0 0 18 0 33 12 16 0 3 1
0 0 16 0 18 0 40 0 3 1
0 0 2 0 30 0 44 0 1 1
0 0 1 100 0 0 1 100 3 0
0 0 2 100 1 100 3 100 3 0
0 0 3 100 2 100 12 0 3 0
0 0 4 100 3 100 1 100 0 0
0 0 6 80 2 100 40 0 0 0
0 0 5 0 3 100 2 100 0 0
0 0 3 0 4 100 5 100 2 0
0 0 12 60 4 100 8 90 1 0
0 0 20 70 12 60 6 100 3 0
0 1 9 0 50 0 0 0 0 0
0 1 14 0 60 0 0 0 1 0
0 1 8 0 0 0 30 0 0 0
0 1 50 0 14 0 20 0 1 0
0 1 30 0 50 0 25 0 3 0
0 0 130 0 0 0 0 0 1 1
0 0 150 0 3 0 2 100 0 1
0 0 90 2 10 0 9 0 1 1
0 0 60 4 2 100 4 100 0 1
0 0 35 0 6 100 12 0 1 1
0 0 45 60 9 0 5 100 0 0
0 0 60 80 3 100 3 100 0 0
"""


@dataclass
class Node:
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None
    label: int = 0


def grow(x: np.ndarray, y: np.ndarray, least: int = 1, depth: int = 8) -> Node:
    """Decision tree by Gini impurity; ties go to the earlier feature and the smaller limit."""
    node = Node(label=int(2 * y.sum() >= len(y)))
    if depth == 0 or len(set(y.tolist())) < 2:
        return node
    best = (len(y) * 2.0 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= limit
            if least <= left.sum() <= len(y) - least:
                impurity = sum(2.0 * len(part) * part.mean() * (1 - part.mean()) for part in (y[left], y[~left]))
                if impurity < best[0] - 1e-9:
                    best = (impurity, f, float(limit))
    if best[1] < 0:
        return node
    left = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow(x[left], y[left], least, depth - 1), grow(x[~left], y[~left], least, depth - 1), node.label)


def trained_tree(labelled: str = TABLE) -> Node:
    rows = np.array([[float(v) for v in line.split()] for line in labelled.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


def without_raw(page: str) -> str:
    """The page without comments, code and closed elements of ``RAW``; tags of unclosed ones stay."""
    page = _CODE.sub(" ", page)
    opened: list[tuple[str, int]] = []
    count = dict.fromkeys(RAW.split(), 0)
    spans, heads = [], []
    for m in _RAW.finditer(page):
        name = m[2].lower()
        if m[0].endswith("/>"):
            spans.append((m.start(), m.end()))
        elif not m[1]:
            opened.append((name, m.start()))
            count[name] += 1
        elif count[name]:
            while True:  # what was opened inside ends here too
                other, start = opened.pop()
                count[other] -= 1
                if other == name:
                    break
                if other == "title":
                    heads.append((start, m.start()))
            (heads if name == "head" else spans).append((start, m.end()))
    heads += [(start, -1) for name, start in opened if name in ("head", "title")]
    spans = _outer(spans)
    starts, done, bodies = [a for a, _ in spans], 0, True
    for start, end in sorted(heads):
        if start < done:
            continue
        at, body = start, None
        while bodies and body is None and (m := _BODY.search(page, at)):
            k = bisect_right(starts, m.start()) - 1
            if k >= 0 and m.start() < spans[k][1]:
                at = spans[k][1]
            else:
                body = m.start()
        bodies = body is not None
        done = min(x for x in (body, end) if x is not None and x >= 0) if body is not None or end >= 0 else start
        if done > start:
            spans.append((start, done))
    out, at = [], 0
    for a, b in _outer(spans):
        out += [page[at:a], " "]
        at = b
    return "".join([*out, page[at:]])


def _outer(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet joined."""
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and a < found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def names_other(names: str) -> bool:
    """Whether a class or id names another part; an element's prefix and modifier (a__b--c) don't count, nor do names of layouts."""
    for token in names.split():
        token = token.split("__")[-1].split("--")[0]
        if _OTHER.search(token) and not LAYOUT_NAMES & set(re.split(r"[^a-z]+", token)):
            return True
    return False


#: Where a block is: in no other part, in one by name, in one by its element or hidden, in an article inside one by name.
FREE, NAMED, FIXED, HELD = range(4)


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """Text and features of the blocks of a page, in page order."""
    found: list[tuple[str, int, bool, int, int]] = []  # text, words in links, in_article, where, kind
    stack: list[tuple[str, bool, int, bool]] = []  # container, in an article, where, in an article or main element
    parts: list[str] = []
    linked, in_link, kind, has_article, free = 0, False, 0, False, False

    def close() -> None:
        nonlocal linked, free
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, in_article, where, in_element = stack[-1] if stack else ("", False, FREE, False)
            found.append((text, linked, in_article, where, kind))
            free = free or in_element and where == FREE
        parts.clear()
        linked = 0

    for k, piece in enumerate(_TAG.split(without_raw(page))):
        if k % 2 == 0:
            if piece:
                parts.append(piece)
                if in_link:
                    linked += len(html.unescape(piece).split())
            continue
        name = (m[1].lower() if (m := _NAME.match(piece)) else "")
        ending = piece.startswith("</")
        if name == "a":
            in_link = not ending
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCKS:
            close()
            in_link = in_link and ending
            if ending:
                kind = 0
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] == name:
                        del stack[at:]
                        break
            else:
                kind = KINDS.get(name, 0)
                if name not in VOID and (name in _CONTAINERS or _NAMES.search(piece) and name not in ("html", "body")):
                    names = " ".join("".join(v) for v in _NAMES.findall(piece)).lower()
                    element = name in ("article", "main")
                    article = element or bool(MAIN_NAMES & set(re.split(r"[^a-z]+", names)))
                    inside = article or bool(stack) and stack[-1][1]
                    fixed = name in OUTSIDE or name == "header" and not inside or bool(_HIDDEN.search(piece))
                    other = fixed or name != "main" and names_other(names)
                    has_article = has_article or article and not other
                    if name in ("p", "li", "td", "th", "dd", "dt", "tr") and stack and stack[-1][0] == name:
                        stack.pop()  # these end where the next one begins
                    _, in_article, where, in_element = stack[-1] if stack else ("", False, FREE, False)
                    if other:
                        where = FIXED if fixed or where == FIXED else NAMED
                    elif element and where in (NAMED, HELD):
                        where = FREE if name == "main" else HELD
                    stack.append((name, in_article or article, where, in_element or element))
    close()
    if not found:
        return []
    words = [float(len(t.split())) for t, *_ in found]
    links = [100.0 * min(1.0, f[1] / w) for f, w in zip(found, words, strict=True)]
    around = lambda v, k: v[k] if 0 <= k < len(v) else 0.0
    outside = lambda where: where != FREE and (free or where != HELD)
    return [(f[0], [1.0 if f[2] else -1.0 if has_article else 0.0, float(outside(f[3])), words[k], links[k], around(words, k - 1), around(links, k - 1),
                    around(words, k + 1), around(links, k + 1), float(f[4])]) for k, f in enumerate(found)]


def is_article(tree: Node, features: list[float]) -> bool:
    while tree.low is not None:
        tree = tree.low if features[tree.feature] <= tree.limit else tree.high
    return bool(tree.label)


def main_text(page: str, tree: Node) -> str:
    return "\n\n".join(text for text, features in blocks(page) if is_article(tree, features))


def extract_text(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    tree = tree or trained_tree()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
