"""The page scan against a quadratic search, what it decides alone, and pages of other kinds than the labelled ones."""

import random

import pytest
from pyspark.sql import functions as F

from churnlens.llm import html_text as h


def best_of_all(scores):
    """Every contiguous run, one by one."""
    found, most = (0, -1), 0.0
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > most + 1e-9:
                most, found = total, (i, j)
    return found


def test_scan_finds_the_best_run():
    r = random.Random(3)
    for _ in range(200):
        scores = [r.choice([-2.0, -0.5, -0.02, 0.0, 1.0, 3.0]) for _ in range(r.randint(0, 30))]
        i, j = h.best_run(scores)
        a, b = best_of_all(scores)
        assert sum(scores[i : j + 1]) == pytest.approx(sum(scores[a : b + 1]))
    for line in h.LABELLED.strip().splitlines():
        scores = h.scored(h.Page(h._outline(line)))[0]
        i, j = h.best_run(scores)
        a, b = best_of_all(scores)
        assert sum(scores[i : j + 1]) == pytest.approx(sum(scores[a : b + 1]))


MENU = "<nav><ul>" + "<li><a href='/x'>Item</a></li>" * 10 + "</ul></nav>"
BODY = "<h1>Title here</h1><p>One two three four five six.</p><p>End.</p>"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div class='wrap'>{}</div>", "<table><tr><td>{}</table>", "{}"])
def test_scan_alone_finds_the_text(around):
    page = h.Page(f"<body>{MENU}{around.format(BODY)}<footer>Some words at the foot</footer><div class='ad'>buy this</div></body>")
    first, last = h.best_run(h.scored(page)[0])
    held = " ".join("".join(page.pieces[e][2] for e in page.events[first : last + 1] if isinstance(e, int)).replace(".", ". ").split())
    assert held in ("Title hereOne two three four five six. End.",)


def test_scan_decides_between_regions():
    text = f"<div>Welcome visitor</div>{MENU}<div class='wrap'>{BODY}</div>"
    assert h.extract(text) == "Title here\nOne two three four five six.\nEnd."
    kept = h.scored(h.Page(text))[1]  # without the scan the welcome would stay
    assert kept[0] and "Welcome" in h.Page(text).pieces[0][2]


@pytest.mark.parametrize("name", ["byline", "toc", "tags", "teaser", "popular", "author", "note", "unheard-of"])
def test_what_an_article_holds_stays(name):
    assert "words of it" in h.extract(f"<article><h1>T</h1><p>some text</p><div class='{name}'>words of it</div><p>end</p></article>")


@pytest.mark.parametrize("part", ["nav", "aside", "footer", "form", "button", "dialog", "div class='ad'", "section id='comments'", "div class='share'", "div role='navigation'", "p hidden", "script"])
def test_what_is_none_of_an_article_goes(part):
    end = part.split()[0]
    assert h.extract(f"<article><h1>T</h1><p>some text</p><{part}>words of it</{end}><p>end</p></article>") == "T\nsome text\nend"


def test_teasers_lead_and_long_adverts():
    card = "<article><h3>card</h3><p>a teaser text</p></article>"
    text = f"{MENU}<div class='content'><h1>Head</h1><p>{'word ' * 60}</p></div><section>{card * 4}</section>"
    assert h.extract(text) == "Head\n" + ("word " * 60).strip()
    assert h.extract("<h1>Head</h1><p class='lead'>the lead</p><article><p>a b c</p></article>") == "Head\nthe lead\na b c"
    assert h.extract(f"<article><p>a b</p><div class='ad'>{'x ' * 500}</div><p>c d</p></article>") == "a b\nc d"


def test_rows(spark):
    """Repeated rows, null ids, empty and very long pages, deep nesting, clashing names."""
    long = "<article>" + "<p>one two</p>" * 40_000 + "</article>"
    deep = "<div>" * 20_000 + "x y z" + "</div>" * 20_000
    rows = [(1, "u", "<p>a b</p>", "k", 5), (1, "u", "<p>a b</p>", "k", 5), (None, None, "<p>c</p>", None, None), (2, "v", None, "k", 1), (3, "v", "", "k", 1), (4, "w", long, "k", 1), (5, "w", deep, "k", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in h.main_texts(frame).collect()), key=lambda x: (x[0] or 0, x[2]))
    assert got[0] == (None, None, "c", 1) and got[1] == got[2] == (1, "u", "a b", 3) and got[3][2] == got[4][2] == ""
    assert got[5][2] == "\n".join(["one two"] * 40_000) and got[6][2] == "x y z"
    assert h.main_texts(frame.where(F.lit(False))).count() == 0
