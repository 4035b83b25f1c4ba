"""Main text by density: which subtree is chosen without names, what names may do, and the query over a whole table."""

import html
import re
from collections import Counter

import pytest

from sumweave.llm import html_text
from sumweave.llm.common import load

FOLDER = "/root/testdata/sf0.01"
ONE = "The quick brown fox jumps over the lazy dog while seven grey geese cross the cold river near our old mill today."
TWO = "Bakers in the northern valley weigh their flour twice before dawn, since damp sacks have often cheated them of a loaf."
THREE = "A tall lamp stood beside the green door; nobody had lit it since the year when both ferries stopped for good."
MENU = "<nav>" + "".join(f"<a href='/{k}'>entry {k}</a>" for k in range(12)) + "</nav>"


def plain(page):
    """The blocks of the only article of a generated page."""
    inside = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    if not inside:
        return ""
    blocks = re.split(r"</?(?:h1|p)>", inside[1])
    texts = (html.unescape(re.sub(r"<br>", " ", b)) for b in blocks)
    lines = (" ".join(re.sub(r"</?b>", "", x).split()) for x in texts)
    return "\n".join(x for x in lines if x)


def test_query_against_known_articles(spark):
    pages = Counter((r["page_id"], r["url"], plain(r["html"])) for r in load(spark, FOLDER, "pages").collect())
    found = Counter((r["page_id"], r["url"], r["text"]) for r in html_text.op5_html_text(spark, FOLDER).collect())
    assert found == pages


def test_density_alone_finds_the_article(spark):
    """No name, of class or element, is looked at."""
    chosen = Counter()
    for r in load(spark, FOLDER, "pages").collect():
        d = html_text.Densities(html_text.Tree(r["html"]))
        chosen[d.t.tag[d.choose(declared=False)]] += 1
    assert chosen["article"] >= 0.93 * sum(chosen.values())


@pytest.mark.parametrize("names", ["class='post tags'", "id='social-history'", "class='comments'", "class='sidebar widget'", "id=search", "role='complementary'", "aria-hidden=true", "style='display:none'", "hidden"])
@pytest.mark.parametrize("element", ["div", "section", "td", "form"])
def test_the_densest_part_stays_whatever_it_is_called(names, element):
    inside = f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
    page = f"<body>{MENU}<div><{element} {names}>{inside}</{element}></div><div>imprint</div></body>"
    if element == "td":
        page = f"<body>{MENU}<table><tr><td {names}>{inside}</td><td><a href=x>more</a></td></tr></table></body>"
    assert html_text.main_text(page) == f"{ONE}\n{TWO}\n{THREE}"


@pytest.mark.parametrize("names", ["class='search-methods'", "id='related-work'", "class='menu'", "id='social'", "class='share'", "class='tags'"])
def test_sections_of_prose_stay(names):
    page = f"<body>{MENU}<article><h1>Head</h1><p>{ONE}</p><section {names}><h2>Part</h2><p>{TWO}</p></section><p>{THREE}</p></article></body>"
    assert html_text.main_text(page) == f"Head\n{ONE}\nPart\n{TWO}\n{THREE}"


def test_math_stays_and_controls_go():
    page = f"<article><p>{ONE} So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>{TWO}</p><button>Press</button><svg><text>t</text></svg></article>"
    assert html_text.main_text(page) == f"{ONE} So x=2 holds.\n{TWO}"


@pytest.mark.parametrize(
    "part",
    ["<aside>See our other tales</aside>", "<div class=ad>Buy one, get two</div>", "<form>Your name</form>", "<div class='share'><a href=q>post it</a> <a href=r>mail it</a></div>", "<div id=comments><p>Great read!</p></div>", "<div class=newsletter>Get it by mail</div>", "<footer>All rights reserved</footer>"],
)
def test_short_parts_inside_go_by_their_names(part):
    for where in (f"<p>{ONE}</p>{part}<p>{TWO}</p>", f"{part}<p>{ONE}</p><p>{TWO}</p>", f"<p>{ONE}</p><p>{TWO}</p>{part}"):
        for around in ("article", "main", "div"):
            assert html_text.main_text(f"<body>{MENU}<{around}>{where}</{around}></body>") == f"{ONE}\n{TWO}"


def test_neighbours_above_the_threshold_join():
    page = f"<body>{MENU}<h1>Head</h1><p>{THREE}</p><div><p>{ONE}</p><p>{TWO}</p><p>{ONE}</p></div><div>imprint and terms</div><div class=ad>Buy one, get two</div></body>"
    assert html_text.main_text(page) == f"Head\n{THREE}\n{ONE}\n{TWO}\n{ONE}"
    parts = f"<body>{MENU}<div><div><p>{ONE}</p><p>{TWO}</p></div><div><p>{THREE}</p><p>{ONE}</p></div></div></body>"
    assert html_text.main_text(parts) == f"{ONE}\n{TWO}\n{THREE}\n{ONE}"


def test_ties_and_very_long_pages():
    part = f"<div><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></div>"
    twice = f"<body>{MENU}{part}{part}<div>imprint</div></body>"
    d = html_text.Densities(html_text.Tree(twice))
    same = [k for k, x in enumerate(d.sum) if d.t.tag[k] == "div" and x]
    assert d.sum[same[0]] == d.sum[same[1]] and d.choose() == same[0]
    assert html_text.main_text(twice) == "\n".join([ONE, TWO, THREE] * 2)
    long = f"<body>{MENU}<article>" + f"<p>{ONE}</p>" * 20_000 + "</article></body>"
    assert html_text.main_text(long) == "\n".join([ONE] * 20_000)
