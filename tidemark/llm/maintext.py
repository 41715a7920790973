"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Each node of a page (``dom.py``) has features: density of its subtree, its
share of the page and of its parent, links and punctuation, tag and attribute
words of its own and of its ancestors, depth, place, and its neighbours.  Trees
boosted on labelled nodes (``boosting.py``) give each node the log-odds that it
is or holds main text.  Nodes are then chosen together: a node counts only with
all its ancestors, and the choice of the largest sum of log-odds is found from
the leaves up.  So nothing is taken from a rejected part, and no part is taken
without its surroundings.

No page is labelled.  Pages whose article is marked up as such (``article`` or
``main``) label themselves; of at most ``MAX_FIT_PAGES`` of these, each is also
shown with its article in other markup, between menus, sidebars, notices, forms
and comments made of its words, so that the trees do not rest on one tag.  Where
no page marks its article, pages made of the pages' words are learned from.
The sample is bounded and does not depend on the order of rows.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.llm import boosting, dom

#: The classifier is fitted on so many pages, and their variants, at most.
MAX_FIT_PAGES = 120
#: Of a sampled page, so many characters of its article serve for fitting; all is extracted.
FIT_CHARS = 20_000
VARIANTS = 3
#: Attribute words that become features.
MAX_NAMES = 62
#: Log-odds that a child shares its parent's choice.
TOGETHER = 0.5
GROUP = 32

TAGS = ["article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "section", "div", "p", "text"]
HEADS, QUOTES = dom.HEADINGS, frozenset(["blockquote", "pre", "figure", "figcaption"])
_TAG = {tag: i for i, tag in enumerate(TAGS)} | dict.fromkeys(HEADS, len(TAGS)) | dict.fromkeys(QUOTES, len(TAGS) + 1)
N_TAGS = len(TAGS) + 2
_MARKS = ".,;:!?"


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    trees: boosting.Boosted


def features(pages: list[dom.Page], names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """One row per node, and the row of each node's parent (-1: none)."""
    number = {name: 1 << i for i, name in enumerate(names)}
    parent, own_tag, tags, own_names, all_names, leaf, first, order, siblings, page_of = ([] for _ in range(10))
    chars, words, linked, marks = [], [], [], []
    for k, page in enumerate(pages):
        start = len(parent)
        children: Counter = Counter()
        for up, tag, node_names, text, link in zip(page.parent, page.tag, page.names, page.text, page.linked):
            above = up + start if up >= 0 else -1
            bit = _TAG.get(tag, -1)
            mine = sum(number[x] for x in node_names if x in number) if node_names else 0
            parent.append(above)
            own_tag.append(bit)
            tags.append((tags[above] if up >= 0 else 0) | (1 << bit if bit >= 0 else 0))
            own_names.append(mine)
            all_names.append((all_names[above] if up >= 0 else 0) | mine)
            leaf.append(text is not None)
            order.append(children[up])
            children[up] += 1
            page_of.append(k)
            if text is None:
                counts = (0, 0, 0, 0)
            else:
                counts = len(text), text.count(" ") + 1, link, sum(map(text.count, _MARKS))
            for column, value in zip((chars, words, linked, marks), counts):
                column.append(value)
        siblings.extend(children[up] for up in page.parent)
        first.append(start)
    n = len(parent)
    before = np.cumsum(chars) - chars
    nodes, leaves = [1] * n, [int(x) for x in leaf]
    for i in range(n - 1, -1, -1):
        up = parent[i]
        if up >= 0:
            for column in (chars, words, linked, marks, nodes, leaves):
                column[up] += column[i]
    up = np.array(parent)
    safe = np.maximum(up, 0)
    chars, words, linked, marks, nodes, leaves, siblings, order = (
        np.array(x, float) for x in (chars, words, linked, marks, nodes, leaves, siblings, order)
    )
    start = np.array(first)[page_of]
    total = np.maximum(chars[start], 1)
    size, links = np.maximum(chars, 1), linked / np.maximum(chars, 1)
    depth = np.zeros(n)
    for i, above in enumerate(parent):
        depth[i] = depth[above] + 1 if above >= 0 else 0
    # neighbours: the nodes before and after with the same parent
    by_parent = np.lexsort((order, up))
    same = up[by_parent[1:]] == up[by_parent[:-1]]
    previous, following = np.full(n, -1.0), np.full(n, -1.0)
    previous[by_parent[1:][same]] = links[by_parent[:-1][same]]
    following[by_parent[:-1][same]] = links[by_parent[1:][same]]
    numeric = [
        np.array(leaf, float), np.minimum(depth, 20), np.log1p(chars), np.log1p(words), links, marks / np.maximum(words, 1),
        chars / np.maximum(words, 1), np.log1p(nodes), np.log1p(leaves), np.log1p(chars / nodes), chars / total,
        (before - before[start]) / total, order / np.maximum(siblings, 1), np.log1p(siblings), np.log1p(chars[safe]),
        links[safe], chars[safe] / total, size / np.maximum(chars[safe], 1), previous, following,
    ]
    own_tag = np.array(own_tag)
    tags, own_names, all_names = (np.array(x, np.int64) for x in (tags, own_names, all_names))
    flags = [own_tag == t for t in range(N_TAGS)] + [(tags >> t) & 1 for t in range(N_TAGS)]
    flags += [(column >> t) & 1 for column in (own_names, all_names) for t in range(len(names))]
    return np.column_stack([*numeric, *flags]).astype(float), up


def decode(parent: np.ndarray, logits: np.ndarray) -> list[bool]:
    """The choice of nodes with the largest sum of log-odds in which each node's parent is chosen."""
    above, total = parent.tolist(), (logits + TOGETHER).tolist()
    for i in range(len(above) - 1, -1, -1):
        if above[i] >= 0 and total[i] > 0:
            total[above[i]] += total[i]
    chosen = [False] * len(above)
    for i, up in enumerate(above):
        chosen[i] = total[i] > 0 and (up < 0 or chosen[up])
    return chosen


def texts_of(sources: list[str | None], model: Model) -> list[str]:
    """Main text of each page: blocks joined by empty lines; '' if there is none."""
    pages = [dom.parse(source or "") for source in sources]
    x, parent = features(pages, model.names)
    chosen = decode(parent, model.trees.logits(x))
    out, start = [], 0
    for page in pages:
        blocks = [text for text, kept in zip(page.text, chosen[start:]) if kept and text is not None]
        out.append("\n\n".join(blocks))
        start += len(page.text)
    return out


def train(pages: DataFrame, html_col: str = "html", max_pages: int = MAX_FIT_PAGES) -> Model:
    """Fit on at most ``max_pages`` pages, drawn by the hash of their html."""
    source = pages.select(F.col(html_col).alias("html")).where(F.col("html").isNotNull())
    marked = source.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))

    def drawn(rows: DataFrame) -> list[str]:
        # hashes alone are compared, so a task sends max_pages numbers and no pages
        hashed = rows.withColumn("h", F.xxhash64("html"))
        first = [row.h for row in hashed.select("h").distinct().orderBy("h").limit(max_pages).collect()]
        if not first:
            return []
        one = hashed.where(F.col("h") <= first[-1]).groupBy("h").agg(F.min("html").alias("html"))
        return [row.html for row in one.orderBy("h").collect()]

    return fit(drawn(marked) or drawn(source))


def fit(sources: list[str]) -> Model:
    examples = [page for source in sources for page in _examples(source)] or _examples("")
    parsed = [dom.parse(source) for source in examples]
    seen = Counter(name for page in parsed for name in {x for names in page.names for x in names})
    names = tuple(sorted(sorted(seen, key=lambda x: (-seen[x], x))[:MAX_NAMES]))
    x, parent = features(parsed, names)
    y = np.array([float(keep) for page in parsed for keep in page.keep])
    for i in range(len(parent) - 1, -1, -1):  # what holds main text is wanted, too
        if y[i] and parent[i] >= 0:
            y[parent[i]] = 1
    return Model(names, boosting.fit(x, y))


_ARTICLE = re.compile(r"<(article|main)(?=[\s>])[^>]*>(.*)</\1\s*>", re.S | re.I)
_BLOCK_END = re.compile(r"</(?:p|h[1-6]|div|ul|ol|table|blockquote)\s*>", re.I)


def _examples(source: str) -> list[str]:
    """The page with its article marked, if it has one, and variants with made surroundings."""
    found = _ARTICLE.search(source)
    rng = random.Random(zlib.crc32(source.encode()))
    words = re.findall(r"[^\s<>&\"'=/]+", re.sub(r"<[^>]*>", " ", source[:FIT_CHARS])) or "some words of a page".split()
    if not found:
        inner = [f"<h1>{_words(rng, words, 4, 9)}</h1>", *(f"<p>{_words(rng, words, 1, 90)}</p>" for _ in range(rng.randint(2, 9)))]
        return [_variant(rng, words, inner) for _ in range(VARIANTS)]
    cut = [0, *(m.end() for m in _BLOCK_END.finditer(found[2], 0, FIT_CHARS))]
    inner = [found[2][i:j] for i, j in zip(cut, cut[1:])] or [found[2][:FIT_CHARS]]
    head, tail = source[: found.start()], source[found.end() :]
    real = f"{head}<{found[1]} data-keep=1>{''.join(inner)}</{found[1]}>{tail[:FIT_CHARS]}"
    return [real, *(_variant(rng, words, inner) for _ in range(VARIANTS))]


def _words(rng: random.Random, words: list[str], least: int, most: int) -> str:
    return " ".join(rng.choices(words, k=rng.randint(least, most)))


#: Markup of made pages: (tag, attribute words); an empty word is an element without attributes.
WRAPPERS = [
    ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post-content"), ("div", "entry-content"),
    ("div", "article-body"), ("section", "story"), ("div", "main-text"), ("div", "article"), ("div", ""), ("section", ""),
    ("div", "text"), ("td", "body"),
]
AROUND = ["wrapper", "container", "page", "row", "col", "layout", "", ""]
MENUS = [("nav", ""), ("ul", "menu"), ("div", "navbar"), ("div", "nav"), ("div", "navigation"), ("nav", "breadcrumb"), ("div", "menu"), ("div", "tabs")]
HEADERS = [("header", ""), ("div", "header"), ("div", "masthead"), ("header", "site-header"), ("div", "banner"), ("div", "topbar")]
FOOTERS = [("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "copyright"), ("footer", "legal")]
SIDES = [("aside", ""), ("div", "sidebar"), ("aside", "related"), ("div", "widget"), ("div", "recommended"), ("section", "popular"), ("div", "related")]
NOTICES = [("div", "cookie"), ("div", "cookie-notice"), ("div", "notice"), ("div", "alert"), ("div", "consent"), ("div", "gdpr"), ("div", "popup"), ("div", "modal"), ("div", "newsletter")]
ADS = [("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("ins", "ad"), ("div", "ad-banner")]
FORMS = [("form", ""), ("form", "search"), ("form", "login"), ("div", "subscribe"), ("form", "signup"), ("form", "contact")]
COMMENTS = [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "comments"), ("div", "discussion"), ("div", "replies"), ("section", "reader-comments")]
SHARES = [("div", "share"), ("div", "social"), ("ul", "tags"), ("div", "meta"), ("div", "pagination")]


def _element(rng: random.Random, kind: tuple[str, str], inner: str, keep: str = "0") -> str:
    tag, name = kind
    tag = "div" if tag in ("ins", "td") else tag
    given = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
    return f"<{tag}{given} data-keep={keep}>{inner}</{tag}>"


def _links(rng: random.Random, words: list[str], most: int = 9) -> str:
    links = [f'<a href="/x">{_words(rng, words, 1, 4)}</a>' for _ in range(rng.randint(2, most))]
    return rng.choice([" | ".join(links), " ".join(links), "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"])


def _text(rng: random.Random, words: list[str], most: int = 60) -> str:
    plain = _words(rng, words, 2, most)
    return rng.choice([plain, f"<p>{plain}</p>", f"<p>{plain}</p><p>{_words(rng, words, 1, most)}</p>"])


def _variant(rng: random.Random, words: list[str], inner: list[str]) -> str:
    """The article in other markup, between parts that are not the article."""

    def some(kinds: list[tuple[str, str]], fill, chance: float) -> list[str]:
        return [_element(rng, rng.choice(kinds), fill())] if rng.random() < chance else []

    def side() -> str:
        return f"<h3>{_words(rng, words, 1, 4)}</h3>" + rng.choice([_links, _text])(rng, words)

    def comments() -> str:
        one = [f"<b>{_words(rng, words, 1, 2)}</b><p>{_words(rng, words, 1, 60)}</p>" for _ in range(rng.randint(1, 5))]
        return f"<h3>{_words(rng, words, 1, 3)}</h3>" + "".join(f'<div class="comment">{x}</div>' for x in one)

    def form() -> str:
        return f"<label>{_words(rng, words, 1, 4)}</label><input name=q><button>{rng.choice(words)}</button>" + rng.choice(["", _text(rng, words, 20)])

    def notice() -> str:
        return _text(rng, words, 30) + rng.choice(["", "<button>OK</button>"])

    def footer() -> str:
        return "&copy; " + _words(rng, words, 1, 12) + rng.choice(["", _links(rng, words), _text(rng, words, 25)])

    def header() -> str:
        return f"<h2>{_words(rng, words, 1, 4)}</h2>" + rng.choice(["", _links(rng, words), _words(rng, words, 2, 8)])

    body = list(inner)
    for _ in range(rng.randint(0, 2)):  # other kinds of blocks within the article
        items = "".join(f"<li>{_words(rng, words, 2, 25)}</li>" for _ in range(rng.randint(2, 6)))
        cells = "".join(f"<tr><td>{_words(rng, words, 1, 4)}</td><td>{_words(rng, words, 1, 4)}</td></tr>" for _ in range(3))
        quote = f"<blockquote>{_words(rng, words, 4, 40)}</blockquote>"
        more = rng.choice([f"<ul>{items}</ul>", f"<ol>{items}</ol>", f"<table>{cells}</table>", quote, f"<h2>{_words(rng, words, 1, 6)}</h2>", f"<p>{_words(rng, words, 1, 5)}</p>"])
        body.insert(rng.randint(0, len(body)), more)
    for kinds, fill, chance in ((ADS, notice, 0.3), (SIDES, side, 0.2), (SHARES, lambda: _links(rng, words, 5), 0.3), (FORMS, form, 0.15), (COMMENTS, comments, 0.15)):
        for part in some(kinds, fill, chance):
            body.insert(rng.randint(0, len(body)), part)
    article = _element(rng, rng.choice(WRAPPERS), "".join(body), "1")
    before = some(HEADERS, header, 0.6) + some(MENUS, lambda: _links(rng, words), 0.7) + some(NOTICES, notice, 0.5)
    before += some(ADS, notice, 0.4) + some(FORMS, form, 0.3) + some(SIDES, side, 0.3)
    after = some(SIDES, side, 0.4) + some(COMMENTS, comments, 0.5) + some(SHARES, lambda: _links(rng, words), 0.3)
    after += some(ADS, notice, 0.3) + some(NOTICES, notice, 0.3) + some(FOOTERS, footer, 0.8)
    page = "".join(before) + article + "".join(after)
    for _ in range(rng.randint(0, 2)):
        name = rng.choice(AROUND)
        page = f'<div class="{name}">{page}</div>' if name else f"<div>{page}</div>"
    return f"<html><body>{page}</body></html>"


def extract(pages: DataFrame, model: Model, html_col: str = "html", into: str = "text") -> DataFrame:
    """The pages with their main text, '' if there is none.

    Null, empty and broken html give what their nodes give; rows and other
    columns stay as they are, but a column named ``into`` is replaced.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c != into]
    at = kept.index(html_col)
    # plain names on the way, as Python stages do not take names with dots
    source = pages.drop(into).toDF(*(f"c{i}" for i in range(len(kept))))
    schema = StructType([*source.schema.fields, StructField("found", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, GROUP):
                part = batch.slice(low, GROUP)
                found = texts_of(part.column(at).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=schema.fieldNames())

    return source.mapInArrow(run, schema).toDF(*kept, into)
