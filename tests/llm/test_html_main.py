"""What the tree may take from an article, both plans on odd urls, forms around pages, anchors."""

import pytest

from defectflow.llm import html_text
from tests.llm.test_more import PAGE


def texts(spark, pages, **parameters):
    return {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame([(*p, "", 0, "") for p in pages], PAGE), **parameters).collect()}


@pytest.mark.parametrize("n", [1, 4, 5, 6, 40])
@pytest.mark.parametrize("broadcast_texts", [50_000, 0])
def test_repeated_words_of_an_article_stay_whatever_the_number_of_pages(spark, n, broadcast_texts):
    cake = "<article><h1>Cake {0}</h1><h2>Ingredients</h2><p>{0} eggs</p><h2>Method</h2><p>bake {0}</p><ul><li>Enjoy</ul></article>"
    law = "<main><h1>Act {0}</h1><p>Of {0} things.</p><p>The act comes into force at once.</p></main>"
    top = "<body><div class=x1>All our pages</div>{0}<div class=x2>Read on</div></body>"
    pages = [(i, f"http://cake/{i}", top.format(cake.format(i))) for i in range(n)] + [(100 + i, f"http://law/{i}", top.format(law.format(i))) for i in range(n)]
    got = texts(spark, pages, broadcast_texts=broadcast_texts)
    around = ("", "") if n >= html_text.MIN_PAGES else ("All our pages ", " Read on")
    for i in range(n):
        assert got[i] == f"{around[0]}Cake {i} Ingredients {i} eggs Method bake {i} Enjoy{around[1]}"
        assert got[100 + i] == f"{around[0]}Act {i} Of {i} things. The act comes into force at once.{around[1]}"


def test_prose_that_also_stands_outside_of_the_article_goes(spark):
    page = "<body><div class=x><p>Join us today</p></div><article><h1>Story {0}</h1><p>text {0}</p><h5>Join us today</h5></article></body>"
    assert texts(spark, [(i, "http://h/", page.format(i)) for i in range(9)]) == {i: f"Story {i} text {i}" for i in range(9)}


@pytest.mark.parametrize("broadcast_texts", [50_000, 0])
def test_both_plans_agree_on_odd_urls(spark, broadcast_texts):
    odd = ["http://h/", "\u00a0http://h/", " \thttp://h/a", "HTTP://H/", "http://h\u2003/", "http://ÄÖ.x/", "http://äö.x/", "x\u00e9://h/", None, "", "h/", "http://h?q", "http://İ.x/", "a+b.c-d://h#"]
    page = "<body><div class=a>Same advert</div><div class=b><p>Story {0} is here</p></div></body>"
    pages = [(i, odd[i % len(odd)], page.format(i)) for i in range(len(odd) * 7)]
    got = texts(spark, pages, broadcast_texts=broadcast_texts)
    by_host = {}
    for i, url, _ in pages:
        by_host.setdefault(html_text.host(url), []).append(i)
    assert all(got[i] == f"Story {i} is here" for some in by_host.values() for i in some if len(some) >= html_text.MIN_PAGES) and len(got) == len(pages)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><form id="aspnetForm"><div><h1>T</h1><p>Story text</p></div></form></body>', "T Story text"),
        ('<body><form><div class=nav>no</div><h1>T</h1><p>Story</p><div class=footer>no</div></form><form>no <input></form></body>', "T Story"),
        ("<body><form><article><p>Story</p></article>no</form></body>", "Story"), ("<body><p>A</p><form><h2>Sign up</h2>no</form></body>", "A"), ("<body><h1>A</h1><form class=search><h1>no</h1></form></body>", "A"),
        ("<article><h1>A</h1><form><h1>no</h1></form>b</article>", "A b"),
        ('<article><h2 id="search">Search trees</h2><p>Body</p><section id="related"><h2>Related work</h2></section><p id=ads>x</p></article>', "Search trees Body Related work x"),
        ('<body><p>A</p><section id="comments">no</section><div id="search">no</div></body>', "A"),
        ("<p>un<img src=x>broken</p>", "unbroken"), ("<p>a<!-- x --!>b<!-- y --> c", "ab c"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page, set()) == text
