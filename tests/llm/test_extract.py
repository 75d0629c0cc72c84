"""Main text of pages: regions by scores, against a plain search and hand-made pages."""

import random
from collections import Counter

import pytest

from postlark.llm import extract
from postlark.llm.extract import Page, Weights

ARTICLE = "<article><h1>Title</h1><p>{}</p></article>"


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def words(n, stem="word"):
    return " ".join(f"{stem}{i}" for i in range(n))


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; 2020 All rights &middot; reserved</footer>"
RICH = page(
    f"<article><header><h1>Head</h1></header><p>{words(30)}</p><aside><p>side note</p></aside>"
    f"<form><input><label>mail</label><button>go</button></form><p>{words(20, 'tail')}</p>"
    '<section class="comments"><article class="comment"><p>nice one</p></article></section></article>'
)
LABELLED = [RICH] + [
    page(f'{NAV}<div class="ad">Buy this now</div>{ARTICLE.format(words(n))}{FOOT}') for n in (30, 60, 90, 120)
]


@pytest.fixture(scope="module")
def weights(spark):
    rows = [(source,) for source in LABELLED]
    return extract.fit(spark.createDataFrame(rows, "html string"))


def text(source, weights):
    one = Page(source)
    return one.text(one.best(weights))


def test_weights_are_sums_over_the_labelled_pages(weights):
    sums, n = {}, 0
    for source in LABELLED:
        one = Page(source)
        first, last = one.region()
        n += 1
        for i, kind in enumerate(one.kinds):
            row = sums.setdefault(kind, [0, 0, 0])
            row[0 if first <= i < last else 1] += one.sizes[i] or kind[0] == "t"
            row[2] += i in (first - 1, last)
    assert Weights({k: tuple(v) for k, v in sums.items()}, n)._known == weights._known
    assert all(value > 0 for kind, value in weights._known.items() if kind[0] == "w")
    assert all(value < 0 for kind, value in weights._known.items() if kind[0] == "t")


def test_best_region_equals_trying_all(weights):
    rng = random.Random(3)
    tags = ["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<br>", "<aside>", "</aside>", "<x>"]
    for _ in range(200):
        one = Page("".join(rng.choice([rng.choice(tags), words(rng.randint(1, 4)) + " "]) for _ in range(25)))
        scores = [weights.score(kind, size) for kind, size in zip(one.kinds, one.sizes)]
        best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
        found = one.best(weights)
        assert (sum(scores[slice(*found)]) if found else 0) == pytest.approx(max(best, 0))


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("", ""),
        ("<html><head><title>only a title</title></head></html>", ""),
        ("plain words", "plain words"),
        (page(NAV + FOOT), ""),
        (page(f"{NAV}<article></article><div class='ad'>one two three</div>{FOOT}"), ""),
        (page(f"{NAV}{ARTICLE.format('one <b>b</b>old&amp;&lt; word')}{FOOT}"), "Title one bold&< word"),
        # Malformed: nothing is closed, a lone <, a > in a quoted value.
        (f"<nav>{NAV}<article><p><b>one<br>two<p>3 < 4 <a title='a > b'>five</a><p>six", "one two 3 < 4 five six"),
        (page(f"<article><p>{words(9)}</p><script>var t = '</p>';</script><p>end</p></article>"), words(9) + " end"),
        (page(f"<article><p>{words(9)}<!-- <p> no -->x</p></article><!-- open"), words(9) + "x"),
        # Parts inside the article are left out, its own header stays.
        (RICH, f"Head {words(30)} {words(20, 'tail')}"),
        # No article element: the blocks with text win over menus, notices and sidebars.
        (
            page(
                f'{NAV}<div id="cookie-notice"><p>{words(40, "c")}</p></div><div class="content with-sidebar">'
                f'<p>{words(50)}</p><p>{words(30, "more")}</p></div><div class="sidebar"><p>{words(60, "s")}</p></div>{FOOT}'
            ),
            f"{words(50)} {words(30, 'more')}",
        ),
        ("<p>a b&nbsp;c\t\n d</p>", "a b c d"),
        ('<a "' * 50 + "<p>x</p>", '<a "' * 50 + " x"),
    ],
)
def test_pages_by_hand(source, expected, weights):
    assert text(source, weights) == " ".join(expected.split())


def test_no_labelled_pages_use_the_plain_weights(spark):
    rows = [("<p>alpha beta gamma delta</p><ul><li>x</li><li>y</li></ul>",), (None,)]
    plain = extract.fit(spark.createDataFrame(rows, "html string"))
    assert (plain.score("w::p:", 2), plain.score("t:p:", 0)) == (2.0, -3.25)
    assert text(rows[0][0], plain) == "alpha beta gamma delta"


def test_rows_nulls_long_pages_and_clashing_columns(spark, weights):
    long = page(ARTICLE.format(words(200_000)))
    rows = [(1, "u", LABELLED[1], 5, "t"), (1, "u", LABELLED[1], 5, "t"), (None, None, None, None, None),
            (2, "v", "", 0, ""), (3, "w", long, 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    out = extract.main_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = Counter(tuple(row) for row in out.collect())
    first = "Title " + words(30)
    assert got[1, "u", first, len(first)] == 2
    assert got[None, None, "", 0] == 1 and got[2, "v", "", 0] == 1
    assert any(row[3] == len("Title " + words(200_000)) for row in got)
    empty = pages.where("page_id = 9")
    assert extract.main_text(empty).count() == 0
