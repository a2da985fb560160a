"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Each scores a log-odds of being main text: a word by the
elements around it (their names, and the words of their class, id and role), a tag by its name, and
never above zero. The weights come from labelled pages: a logistic regression for words and counts
for tags, both fitted at first use on ``LABELLED``. A linear scan then finds the contiguous region
of greatest sum, and that region is the main text, less the elements inside it that score below zero
(an advert, a form, reader comments). Words in a row that score below zero count by the logarithm of
their number, and by ``RUN_SHARE``, so that an advert between two parts of an article does not cut it in two.

Defined results: a null or empty page has an empty text; of a page cut off anywhere, what is there
counts; unclosed and stray tags are tolerated; other white space than ASCII (no-break spaces) counts
as white space; a line break element is white space inside its block; hidden elements have no text;
repeated rows and null ids get a row each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|</[^a-zA-Z][^>]*+>|<(?:/?[a-zA-Z!?][^>]*+)\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?|["'=]""")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Ends of elements that authors leave out: an opening tag closes an open one of these.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose text is not shown as text of the page.
UNSEEN = frozenset("head select datalist svg canvas audio video object map math".split())

#: Labelled pages, one a line, as outlines: ``tag.class:9`` is an element of nine words, ``*3`` three of them, ``!`` marks
#: main text and ``~`` what is not, down to a ``~`` or ``!`` inside. What carries no mark is not main text.
LABELLED = """
nav(ul(li(a:1)*6)) div.ad:8 !article(h1:6 p:40 p:25 p:1 p:60) footer:12
header(a.logo:2 nav(a:1*5)) !main(h1:5 p.byline:4 p:50 ~div.ad:7 p:30 ul(li:6*3) p:20 ~aside(h3:2 ul(li(a:5)*3))) footer(p:9 a:1*3)
div#header(h1:3 p:5) div.menu(a:1*7) !div#content(h1:6 p:30 p:45 p:2 blockquote:15) div#sidebar(h3:2 ul(li(a:4)*5) p:18) div#footer(p:12)
div.topbar(a:1*4) div.cookie-banner(p:20 button:1*2) !article.post(header(h1:7 p.meta:5 time:3) p:35 p(a:8) figure(figcaption:9) p:28 ~div.share(a:1*4) ~form.newsletter(label:4 button:1) p:40) section.comments(h2:2 div.comment(p:22)*3) footer:15
center(table(tr(td(a:1)*5))) !table(tr(td(h2:4 p:33 p:41 p:12))) center(p.copyright:6)
nav.breadcrumbs(a:1*3) !div.entry-content(h1:5 div.author:3 p:26 h2:3 p:37 pre:20 table(tr(th:1*3) tr(td:2*3)) p:19) div.related-posts(h3:2 ul(li(a:6)*4)) div#disqus(p:30) footer.site-footer(div:8 ul(li(a:1)*5))
p:22 p:48 p:9 p:31
!div(h1:4 p:29 p:33 p:44) div(a:1*6) div(a:2*3)
div(a:1*5) !div(h2:5 div:24 div:31 div:3 ul(li:5*4)) div.copyright:7
body(div.header(span:3) div.nav(ul(li(a:1)*5)) !div.article-body(p:40 ~div.advertisement(p:10) p:36 ~div.sponsored(a:6 p:9) p:18) div.sidebar(div.widget(h4:2 p:16) div.widget(h4:2 ul(li(a:3)*4))) div.footer(p:10))
header.masthead(h1:2 p:6) nav(ul.menu(li(a:1)*6)) !section.body(h1:6 p.lead:24 p:40 h3:3 p:35) aside.sidebar(section(h3:2 p:20) section(h3:2 p:14)) footer(p:11)
!h1:7 !p.lead:25 !article(p:30 p:42 p:17) section.comments(article.comment(header:3 p:20)*3) aside(p:15)
div.notice(p:12) div.alert:9 !main(article(h1:5 p:28 ~div.ad-slot(p:6) p:31 ~section#comments(h2:1 ol.commentlist(li(div.comment-body(p:25)))*2) ~div.respond(form(label:2 textarea:1)))) footer.copyright:8
div.page(div.login(form(label:1*2 button:1)) div.search(form(label:1 button:1)) div.navigation(a:1*6) !div.main(div.text(h1:4 p:33 p:27 ol(li:7*3) p:14)) div.promo(h4:3 p:13) div.popup(p:17) div.subscribe(p:12 form(label:2 button:1)) div.legal(p:25) div.pagination(a:1*4))
!div.content(h1:5 p:50 p:44 p:38 p:61) section(article(h3:4 p:11)*4) footer:9
!div#main(h1:3 p:60 p:52) section.teasers(article(h3(a:5) p:12)*3) nav.pager(a:1*2)
div.toolbar(a:1*3) div.banner(p:8) !div.story(h1:6 p.summary:18 p:35 p:48 div.note:10 ~div.related(h4:2 a:5*3) p:22 div.tags(a:1*3)) div.recommended(h3:2 a:6*4) div.outbrain(a:7*4) div.discussion(p:30*3)
div.skip(a:3) header(div.logo:2) !div.post-content(h1:4 p:31 dl(dt:2 dd:12 dt:2 dd:15) p:29 details(summary:4 p:16)) div.social(a:1*4) div.feedback(p:6 button:1*2) div.disclaimer(p:30) div.privacy(p:15) div.gdpr-consent(p:22 button:1)
!article(section(h2:3 p:30) section(h2:4 p:36 ~aside(p:14) p:20) section(h2:2 ul(li(a:4)*3)) p:12 div.footnotes(ol(li:8*2))) div:9 div(a:2*4)
nav(a:1*5) !article(h1:5 p:44 ~nav(a:3*4) p:23 ~form(p:6 label:2 button:1) p:18 ~footer(p:9 a:1*2)) p:7 p(a:3) div.modal(p:12) dialog(p:14) menu(li(a:2)*3)
!article(p:1) footer(p:40) div.ad:25
!article(h1:2 p:3) nav(ul(li(a:2)*20)) div.advert(p:30) aside(p:45) footer(p:50) div.copyright:12
!main(p:4) header(p:20) div.sidebar(p:35) div.comments(p:40) div.notice(p:18)
div.ads(p:9) div.adsense:7 div.sponsor(p:8) !article(h1:4 div.hero(p:16) p:38 ~div.promotion(p:9) p:21 ~div.signup(p:8 button:1) p:33 ~div.adverts(p:7) p:15 ~div.reply(p:18) ~div.replies(p:20)) div.taboola(a:6*3) div.sitemap(a:1*9) div.overlay(p:10) div.notification(p:9)
div[role=banner](p:5 a:1*3) div[role=navigation](a:1*6) !div[role=main](h1:5 p:37 p:28 div[role=note](p:12)) div[role=complementary](p:19 a:3*3) div[role=search](label:1) div[role=contentinfo](p:14)
!article(header(h1:6 div.author:3) div.article-text(p:42 p:30 h2:3 p:25) footer.author-bio(p:14)) footer.page-footer(p:13)
header(p:6) !div(h1:5) !div(p:47) !div(p:38) footer(p:9)
!section(h1:4 p:29 p:51 section(h2:3 p:33)) section.related(h2:2 ul(li(a:5)*4)) section.newsletter(p:12)
div.menu(a:1*2) !div.wrap(h1:1 p:4 ~section#comments(p:3)) div.sidebar:2
div.container(ul(li(a:1)*6)) !div.container(h2:4 p:30 h3:3 p:22) div.container(a:2*4)
ul(li(a:1)*6) !div(h1:4 p:30 h3:3 ul(li:4*3) h3:2 p:25) ul(li(a:2)*4) div.foot(a:1*3)
header(div:3) !div.wrapper(h2:3 p:26 h4:2 p:31 ~aside(h3:2 p:12) p:9) footer(div:8)
!article(h1:4 p:20 div.tags(a:1*3) div.toc(a:2*3) div.popular(p:6) div.teaser(p:9)) section(h3:2 p:8) div(p:6)
nav(a:1*4) !div.page(h1:3 p:18 p:27) footer(p:6)
div.navbar(div:6) div.cookie(p:14) !div.page(h1:3 p:30 ~div.comment(p:12)*3 ~button:2 p:22) div.widget(p:9) div.login:4 div.search:3 div.breadcrumb:3 div.breadcrumbs:3 div.pager:4 div.slot:7 div.consent:11 div.gdpr:9 div.respond:12
!section(h1:3 p:22 p:35) section(ul(li(a:3)*5)) header(p:5)
"""
#: Elements that lay out a page and say nothing of what they hold.
LAYOUT = frozenset("html body div span p center font table tbody thead tr td th ul ol li dl dt dd a b i em strong u small section h2 h3 h4 h5 h6 time sup sub code".split())
#: The least and the greatest cost of a tag, what of its log-odds it costs between, and what words below zero in a row cost of theirs.
TAG_COSTS, TAG_SHARE, RUN_SHARE = (0.02, 0.6), 0.2, 0.1


def _names(attributes: str) -> tuple[list[str], bool]:
    """Words of class, id and role; and whether the element is hidden."""
    found, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "").lower(), (m[2] or "").strip("\"'")
        if key in ("hidden", "aria-hidden"):
            hidden |= key == "hidden" or value.lower() == "true"
        elif key in ("class", "id"):
            found += [p.lower() for p in _PART.findall(value)]
        elif key == "role":
            found += [f"role {p.lower()}" for p in _PART.findall(value)]
        elif key == "data-label":
            found.append(f"label {value}")
    return found, hidden


@lru_cache(50_000)
def _features(tag: str, attributes: str) -> tuple[frozenset[str], bool]:
    names, hidden = _names(attributes) if attributes else ([], False)
    return frozenset(names if tag in LAYOUT else [f"<{tag}>", *names]), hidden or tag in UNSEEN


class Page:
    """A page as pieces of text and opening tags, in order.

    A state is the set of features of all open elements. A piece is (block, state, text, words, in a
    link); an event is a piece's number, or a tag's name and the state it opens.
    """

    def __init__(self, page: str):
        self.states: list[frozenset[str]] = [frozenset()]
        self.unseen = [False]
        self.pieces: list[tuple[int, int, str, int, bool]] = []
        self.events: list[int | tuple[str, int]] = []
        self.top = [-1]  # of each state: the outermost article or main around it
        self.blocks = 0
        self._read(page)
        words: Counter = Counter()
        for _, state, _, n, _ in self.pieces:
            words[self.top[state]] += n
        del words[-1]
        largest = max(words, key=words.get, default=-1)
        #: The article with more than half the words of all articles, if there is one.
        self.chief = largest if words and 2 * words[largest] > sum(words.values()) else None

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # of (tag, state)
        open_: Counter = Counter()
        known: dict[tuple, int] = {}
        fresh, block, at, n, tops = True, -1, 0, len(page), 0

        def text(a: int, b: int) -> None:
            nonlocal fresh, block
            if a >= b:
                return
            raw = page[a:b]
            if fresh:
                if not raw.strip():
                    return
                block, fresh = block + 1, False
            self.events.append(len(self.pieces))
            self.pieces.append((block, stack[-1][1], raw, len(raw.split()), open_["a"] > 0))

        def close() -> None:
            open_[stack.pop()[0]] -= 1

        while at < n:
            m = _TAG.search(page, at)
            if m is None:
                break
            text(at, m.start())
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                fresh = True
            if closing:
                if open_[tag] > 0:
                    while stack[-1][0] != tag:
                        close()
                    close()
                continue
            if tag == "br" and not fresh:
                self.pieces.append((block, stack[-1][1], " ", 0, False))
            if tag in RAW:
                self.events.append((tag, stack[-1][1]))
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if tag in VOID or (attributes or "").endswith("/") and tag not in BLOCK and tag != "a":
                self.events.append((tag, stack[-1][1]))
                continue
            if stack[-1][0] in IMPLIED.get(tag, ()) or tag in BLOCK and stack[-1][0] == "p":
                close()
            outer = stack[-1][1]
            own, hidden = _features(tag, attributes if attributes and re.search("class|id|role|hidden|data-label", attributes, re.I) else "")
            top = self.top[outer]
            if tag in ("article", "main") and top < 0:
                top, tops = tops, tops + 1
            key = (outer, own, hidden, top)
            if key not in known:
                self.top.append(top)
                known[key] = len(self.states)
                self.states.append(self.states[outer] if own <= self.states[outer] else self.states[outer] | own)
                self.unseen.append(self.unseen[outer] or hidden)
            self.events.append((tag, known[key]))
            stack.append((tag, known[key]))
            open_[tag] += 1
        text(at, n)
        self.blocks = block + 1

    def features(self, state: int) -> frozenset[str]:
        """The state's features for the model: ``articles`` in an article that isn't the chief one, ``beside`` outside the chief one."""
        own, top = self.states[state], self.top[state]
        if top >= 0 and top != self.chief:
            own = own - {"<article>"} | {"articles"}
        return own if self.chief is None or top == self.chief else own | {"beside"}

    def link_shares(self) -> list[float]:
        """Share of each block's words that are in links; 0 in the chief article, whose links are its own."""
        words, links = [0] * self.blocks, [0] * self.blocks
        for block, state, _, n, link in self.pieces:
            words[block] += n
            links[block] += n * (link and (self.chief is None or self.top[state] != self.chief))
        return [x / y if y else 0.0 for x, y in zip(links, words, strict=True)]


def _outline(line: str) -> str:
    """The page of an outline."""
    token = re.compile(r"\s*(?:([!~]?)([a-z0-9]+)((?:[.#][\w-]+|\[role=\w+\])*)(?::(\d+))?(\()?|(\))(?:\*(\d+))?|\*(\d+))")

    def run(at: int) -> tuple[str, int]:
        parts: list[str] = []
        while at < len(line) and (m := token.match(line, at)):
            at = m.end()
            if m[6]:
                return "".join(parts), m.start(6)
            if m[8]:
                parts[-1] *= int(m[8])
                continue
            inner = "w " * int(m[4] or 0)
            if m[5]:
                inner, at = run(at)
                end = token.match(line, at)
                at, times = end.end(), int(end[7] or 1)
            else:
                times = 1
            classes = " ".join(re.findall(r"[.#]([\w-]+)", m[3]))
            role = "".join(f' role="{r}"' for r in re.findall(r"role=(\w+)", m[3]))
            label = f' data-label="{"!~".index(m[1])}"' if m[1] else ""
            parts.append(f'<{m[2]} class="{classes}"{role}{label}>{inner}</{m[2]}>' * times)
        return "".join(parts), at

    return run(0)[0]


class Weights:
    """Log-odds fitted on the labelled pages."""

    def __init__(self) -> None:
        rows: list[tuple[frozenset[str], float, bool]] = []
        tags = {True: Counter(), False: Counter()}
        for line in LABELLED.strip().splitlines():
            whole = "!" not in line  # a page of text alone
            page = Page(_outline(line))
            shares = page.link_shares()
            main = [whole or "label 0" in s and "label 1" not in s for s in page.states]
            rows += [(page.features(s) - {"label 0", "label 1"}, shares[b], main[s]) for b, s, _, n, _ in page.pieces if n]
            for e in page.events:
                if not isinstance(e, int):
                    tags[main[e[1]]][e[0]] += 1
        # What never holds main text is none inside an article either, whichever page it was seen on.
        in_main = {f for own, _, y in rows if y for f in own}
        moved = {frozenset(f for f in own if f not in in_main and f not in ("beside", "articles")) for own, _, _ in rows}
        rows += [(own | {home}, 0.0, False) for own in sorted(moved - {frozenset()}, key=sorted) for home in ("<article>", "content")]
        names = sorted({f for own, _, _ in rows for f in own})
        place = {f: i for i, f in enumerate(names)}
        x = np.zeros((len(rows), len(names) + 2))
        for i, (own, share, _) in enumerate(rows):
            x[i, [place[f] for f in own if f in place]] = 1
            x[i, -2:] = share, 1
        y = np.array([m for _, _, m in rows], float)
        # Each side weighs the same, and the ridge keeps rare features small.
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), 1e-4)
        ridge[-1] = 1e-5
        for _ in range(25):  # Newton's method
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.feature = dict(zip(names, w[:-2].tolist(), strict=True))
        self.link, self.bias = float(w[-2]), float(w[-1])
        totals = {side: sum(c.values()) for side, c in tags.items()}
        odds = {t: math.log((tags[True][t] + 0.5) / (totals[True] + 1) / ((tags[False][t] + 0.5) / (totals[False] + 1))) for t in {*tags[True], *tags[False]}}
        low, high = TAG_COSTS
        self.tag = {t: -min(high, max(low, -v * TAG_SHARE)) for t, v in odds.items()}

    def word(self, features: frozenset[str]) -> float:
        known = self.feature
        return self.bias + sum(known.get(f, 0.0) for f in features)


@lru_cache(1)
def weights() -> Weights:
    return Weights()


def scored(page: Page) -> tuple[list[float], list[bool]]:
    """(score of each event, whether each piece is main text if the region holds it)."""
    model = weights()
    seen = {s: model.word(page.features(s)) for s in {p[1] for p in page.pieces}}
    shares = page.link_shares()
    plain, kept = [0.0] * len(page.pieces), [False] * len(page.pieces)
    for i, (block, state, _, _, _) in enumerate(page.pieces):
        own = seen[state]
        # An element that is none of the text goes as it is; else its block is judged by its links, too.
        plain[i] = own + model.link * shares[block] if own >= 0 else own
        kept[i] = plain[i] >= 0 and not page.unseen[state]
    scores, run = [], 0
    for e in page.events:
        if not isinstance(e, int):
            scores.append(model.tag.get(e[0], -TAG_COSTS[0]))
            continue
        n = page.pieces[e][3]
        if page.unseen[page.pieces[e][1]]:
            scores.append(0.0)
        elif kept[e]:
            scores.append(plain[e] * n)
            run = 0 if n else run
        else:
            scores.append(RUN_SHARE * plain[e] * (math.log2(1 + run + n) - math.log2(1 + run)))
            run += n
    return scores, kept


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous run of greatest positive sum; (0, -1) if there is none."""
    best, found, total, start = 0.0, (0, -1), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i)
    return found


def extract(text: str | None) -> str:
    """The main text; blocks are joined by one line feed."""
    if not text:
        return ""
    page = Page(text)
    scores, kept = scored(page)
    first, last = best_run(scores)
    held = [e for e in page.events[first : last + 1] if isinstance(e, int)]
    if not held:
        return ""
    blocks: dict[int, list[str]] = {}
    for i in range(held[0], held[-1] + 1):  # with the line breaks between
        if kept[i]:
            blocks.setdefault(page.pieces[i][0], []).append(page.pieces[i][2])
    lines = (" ".join(html.unescape("".join(pieces)).split()) for pieces in blocks.values())
    return "\n".join(line for line in lines if line)


def _extract_all(pages: list[str]) -> dict[str, list]:
    texts = [extract(p) for p in pages]
    return {"text": texts, "n_chars": [len(t) for t in texts]}


def main_texts(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the kept columns, text (empty if none), n_chars (its code points)."""
    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    return map_texts(rows, _extract_all, "text string, n_chars long", "_html")
