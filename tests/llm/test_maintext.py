import html
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from tidemark.llm import boosting, dom, maintext, queries

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"


def expected(source):
    """The blocks of the only article, by its markup."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = (html.unescape(x.replace("<b>", "").replace("<br>", " ")) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


@pytest.fixture(scope="module")
def model():
    rows = duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' ORDER BY page_id LIMIT 100").fetchall()
    return maintext.fit([row[0] for row in rows])


def blocks(source):
    page = dom.parse(source)
    return [x for x in page.text if x is not None]


def test_parse_broken_markup():
    assert blocks("<p>a <b>b<p>c</p>d<li>e<li>f &amp; g&nbsp;h &#233;&copy") == ["a b", "c", "d", "e", "f & g h é©"]
    assert blocks("x<script>if (a<b) '</p>'</script>y<!-- <p> --><style>p{}</style>z") == ["xyz"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert blocks('<p title="a>b" class=x>c</p><a href="x>d')[0] == "c"
    assert blocks("a < b <p>c") == ["a < b", "c"]
    assert blocks("<head><title>t</title><p>x") == ["x"]
    assert blocks("<h1>a<h2>b</h1>c") == ["a", "b", "c"]
    assert blocks("") == blocks("   \n") == blocks("<div><p></p></div>") == []
    deep = "<div>" * 3000 + "x" + "</div>" * 10
    assert blocks(deep) == ["x"]


def test_decode_is_the_best_consistent_choice():
    rng = random.Random(4)
    for _ in range(100):
        n = rng.randint(1, 9)
        parent = [-1, *(rng.randrange(i) for i in range(1, n))]
        logits = np.array([rng.uniform(-3, 3) for _ in range(n)])
        chosen = maintext.decode(np.array(parent), logits)
        assert all(chosen[up] for i, up in enumerate(parent) if chosen[i] and up >= 0)

        def worth(choice):
            return sum(x + maintext.TOGETHER for x, c in zip(logits, choice) if c)

        every = [c for c in itertools.product([False, True], repeat=n) if all(up < 0 or c[up] for i, up in enumerate(parent) if c[i])]
        assert abs(worth(chosen) - max(map(worth, every))) < 1e-9


def test_boosting_learns_interactions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000], columns=1.0)
    assert (((trees.logits(x[2000:]) > 0) == (y[2000:] > 0)).mean()) > 0.95
    assert boosting.fit(x[:5], np.zeros(5)).logits(x[:2]).max() < 0


def test_other_markup_and_consistency(model):
    words = "the of and to in a is that it was for on with as his they at be this from".split()
    rng = random.Random(8)

    def text(n):
        return " ".join(rng.choices(words, k=n)) + "."

    main = [text(6), text(60), text(2), text(80), text(35)]
    body = f"<h1>{main[0]}</h1>" + "".join(f"<p>{x}</p>" for x in main[1:])
    links = "".join(f'<li><a href="/">{text(2)}</a></li>' for _ in range(6))
    comments = f'<div id="comments"><h3>x</h3><div class="comment"><p>{text(40)}</p></div></div>'
    for tag, name in (("div", "post-content"), ("main", "main"), ("div", "article-body")):
        page = (
            f'<body><div class="header"><h2>s</h2></div><ul class="menu">{links}</ul><div class="cookie-notice">{text(9)}<button>ok</button></div>'
            f'<{tag} class="{name}">{body}</{tag}><aside><h3>x</h3>{text(20)}</aside>{comments}'
            f'<form><label>{text(2)}</label><input></form><div class="footer">&copy; {text(4)}</div></body>'
        )
        assert maintext.texts_of([page], model) == ["\n\n".join(main)]


def test_extract_edges(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<nav><ul><li><a href=x>a</a></li></ul></nav>"), (3, "u", "no markup at all & <"), (4, None, "<p>" * 50)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' parent", "'y' AS text", "'z' `a.b`")
    found = maintext.extract(pages, model)
    assert sorted(found.columns) == sorted(pages.columns)
    got = [(r.page_id, r.text) for r in found.collect()]
    assert [x[0] for x in got] == [1, 2, 3, 3, 4] and got[0][1] == got[1][1] == got[4][1] == ""
    assert maintext.extract(pages.limit(0), model).collect() == []
    empty = maintext.train(pages.limit(0))
    assert maintext.texts_of([None, "<p>a"], empty)[0] == ""
    unmarked = maintext.train(pages.where("page_id > 2"))
    assert unmarked.trees.features.size


def test_main_text_query_against_markup(spark):
    sources = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.op11_main_text(spark, SF).collect()
    assert len(found) == len(sources)
    for r in found:
        assert r.text == expected(sources[r.page_id].html) and r.n_chars == len(r.text) and r.url == sources[r.page_id].url
