import random
import re
from math import exp

import pytest

from tidemark.llm import html_text
from tidemark.llm.html_text import blocks, extract, main_text, scores

ARTICLE = "<h1>Head &amp; line</h1><p>First  long, long paragraph. With\n two sentences, at least.<p>Second &lt;one&gt;, which is <b>longer, too. And it goes on, yes.</p><ul><li>item one, first</li><li>item two</ul>"
TEXT = "Head & line\nFirst long, long paragraph. With two sentences, at least.\nSecond <one>, which is longer, too. And it goes on, yes.\nitem one, first\nitem two"


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title><style>p{{}}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a>x</a></ul></nav><article>{ARTICLE}</article><footer>&copy; me, you.</footer></body></html>",
    f"<body><div id='menu'><a>one</a> <a>two</a></div><div class='content'>{ARTICLE}</div><div class='sidebar'><p>Related, things. To read, now.</p></div><div id=comments><p>I like it, a lot. Yes, yes.</p></div>",
    f"<body><main>{ARTICLE}</main><aside>note, this.</aside><form>name <input> <textarea>x</textarea></form><script>var a='</p>';</script><!-- <p>no, no.</p> --><div class='cookie-notice'>We use cookies, all of them.</div>",
    f"<body><table><tr><td>{ARTICLE}</table><div class=ad>Buy, now.</div>",
    f"<article>{ARTICLE}",
])
def test_pages(page):
    assert extract(page) == TEXT


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("   ", ""), ("only text", "only text"), ("<p>a</p>", "a"), ("<script>x</script>", ""), ("<script>x", ""), ("<p>a&nbsp;b &#x41;&eacute;</p>", "a b Aé"), ("<nav>a, b.</nav>", "")])
def test_odd_pages(page, text):
    assert extract(page) == text


def test_long_and_broken_pages():
    assert extract("<p>" + "word, " * 200_000 + "</p>").count("word") == 200_000
    assert extract("<div>" * 5000 + "x, y." + "</p>" * 5000) == "x, y."
    extract('<p title="' * 2000 + "a < b <" * 2000)


def test_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "z"), (1, "u", f"<article>{ARTICLE}</article>", "z"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0)], key=repr)
    assert main_text(df.limit(0)).collect() == []


def test_links_of_an_article_are_kept():
    page = "<nav><a href=/>Home</a></nav><article><h1><a href=/x>A headline, linked</a></h1><p>A paragraph, long enough. And a second sentence, too.</p><h2>Sources</h2><ul><li><a href=/1>First source</a><li><a href=/2>Second source</a></ul><div class=related><a href=/3>Read this</a></div></article><ul><li><a href=/4>Elsewhere</a></ul>"
    assert extract(page) == "A headline, linked\nA paragraph, long enough. And a second sentence, too.\nSources\nFirst source\nSecond source"


LONG = "A paragraph, long enough to tell. And a second sentence, too; it goes on, as they do."


@pytest.mark.parametrize(("part", "text"), [
    ("<section id='related-work'><h2>Related work</h2><p>Others did this, and that. They found it, as we do, to be of use.</p></section>", "Related work\nOthers did this, and that. They found it, as we do, to be of use."),
    ("<p class='promotion'>Promoted to captain.</p>", "Promoted to captain."),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be a number.</p>", "Let x=2 be a number."),
    ("<h2 id='search'>Search trees</h2>", "Search trees"),
    ("<table><tr><th>Year<th>Sum<tr><td>1999<td>12</table>", "Year\nSum\n1999\n12"),
    ("<ol><li><a href=1>A source</a><li><a href=2>Another</a></ol>", "A source\nAnother"),
    ("<p>Of.</p><my-note>A custom element</my-note>", "Of.\nA custom element"),
    ("<div class='ad'>Buy this, now.</div><div class='share'><a>Tell</a></div><aside>x, y.</aside><footer>z</footer>", None),
    ("<p hidden>not seen</p><script>a</script><form>Name, please.</form>", None),
])
def test_parts_of_an_article(part, text):
    """Whatever an article holds stays but for what HTML or its name says to be something else."""
    want = "\n".join(["Title", LONG, *([text] if text else []), LONG])
    for page in (f"<body class='has-sidebar'><div>Site</div><article class='post comments-open'><h1>Title</h1><p>{LONG}</p>{part}<p>{LONG}</p></article><div>Later, maybe.</div>", f"<main><div id=c><h1>Title</h1><p>{LONG}</p>{part}<p>{LONG}</p></div></main>"):
        assert extract(page) == want


def test_two_articles_and_what_stands_between():
    page = f"<body><article class=a><h2>One</h2><p>{LONG}</p></article><div class=ad>Buy, now.</div><div>Short</div><article class='b c'><h2>Two</h2><p>{LONG}</p></article>"
    assert extract(page) == f"One\n{LONG}\nTwo\n{LONG}"


PLAIN = f"<body><div><div>Menu</div><div>Home</div></div><div><h1>Title</h1><p>{LONG}</p><table><tr><td>1<td>2</table><p>{LONG}</p></div><div><ul><li>nice one<li>me too, yes</ul></div><div>Imprint and such</div>"


def test_a_page_without_landmarks():
    assert extract(PLAIN) == f"Title\n{LONG}\n1\n2\n{LONG}"


def test_the_ratios_decide(monkeypatch):
    """Without them, menus and comments stay."""
    monkeypatch.setattr(html_text, "scores", lambda page: {b.path: b.weight for b in page})
    assert "Menu" in extract(PLAIN) and "nice one" in extract(PLAIN)


def second_scores(page):
    """The same from the definition, path by path."""
    paths = {b.path for b in page}
    of = lambda p: [i for i, b in enumerate(page) if b.path == p]
    chars = lambda b: max(0, len(b.text) - b.link)
    marks = lambda b: len(re.findall(r"[.,;:!?…。、，；：！？¿¡]", b.text)) if b.link < 0.6 * len(b.text) else 0
    out = {}
    for p in paths:
        fused = 1.0
        for k, f in enumerate((chars, marks)):
            mean = {q: sum(f(page[i]) for i in of(q)) / len(of(q)) for q in paths}
            even = []
            for i in of(p):
                near = [(exp(-((j - i) ** 2) / 2) * (1 if page[j].nodes[:-1] == page[i].nodes[:-1] else 0.05), mean[page[j].path]) for j in range(len(page)) if abs(i - j) <= 2]
                even.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
            fused *= k + sum(even) / len(even)
        out[p] = fused * max(page[i].weight for i in of(p))
    return out


def test_scores_are_those_of_the_definition():
    rng = random.Random(3)
    tags = ["div", "p", "ul", "li", "h2", "section", "article", "div class=ad", "td", "a", "b"]
    for _ in range(60):
        html = "".join(f"<{'/' * (rng.random() < 0.4)}{rng.choice(tags)}>" + "word, and. "[: rng.randint(0, 11)] * rng.randint(0, 6) for _ in range(rng.randint(1, 40)))
        page = blocks(html)
        got, want = scores(page), second_scores(page)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 * max(1, want[p]) for p in got)


def test_the_test_tables_pages(spark):
    """Of these pages the article element holds the text, whatever its paragraphs' lengths."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        own = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(html_text.unescape(re.sub(r"<[^>]+>", " " if x.startswith("<br") else "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", own)]
        assert extract(r.html) == "\n".join(filter(None, want))


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><header><h1>My Blog</h1><p>A tagline, short.</p><ul><li><a>Home</a></ul></header><div id=wrap><div class=post><h2>Title</h2><div class=meta>By Jo</div><p>{LONG}</p><ul><li>One<li>Two</ul><p>End.</p></div><div class=sidebar><p>I write, often.</p></div></div><div id=comments><p>Great post, thanks!</p></div>", f"Title\nBy Jo\n{LONG}\nOne\nTwo\nEnd."),
    (f"<body><div><a href=1>A</a> | <a href=2>B</a></div><div><div><h1>Head</h1></div><div>{LONG}<br>{LONG}</div></div><div>Copyright, all rights reserved, 2020.</div>", f"Head\n{LONG} {LONG}"),
    ("<body><div class='notice'>We will be down, on Monday, for a while. Sorry for that, all.</div><main><article><h1>H</h1><p>Of.</p></article></main>", "H\nOf."),
    (f"<body><form><div><h1>H</h1><p>{LONG}</p></div><select><option>x</select></form></body>", f"H\n{LONG}"),
    ("<body><form>Your name, please. Thanks! <input></form></body>", ""),
    (f"<article><header><h1>Head</h1></header><section><h2>A</h2><p>{LONG}</p></section><section class=comments><p>{LONG}</p></section></article>", f"Head\nA\n{LONG}"),
])
def test_whole_pages(page, text):
    assert extract(page) == text
