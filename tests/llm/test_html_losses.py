"""op5: article text that must not be lost, and noise that must go."""

import pytest

from tidelog.llm import html


def test_headings_that_are_called_headers_stay():
    page = '<html><body><div class="header">Site</div><article><h1 class="header">Big title</h1><h2 class="section-header">Part one</h2><p>para</p><h3 class="header">Sub</h3><div class="table-header">Table one</div><p>more</p></article></body></html>'
    assert html.main_text(page) == "Big title\n\nPart one\n\npara\n\nSub\n\nTable one\n\nmore"


def test_a_page_in_one_form_keeps_its_text_and_loses_controls():
    page = '<body><form id="aspnet"><div class="content"><h1>Title</h1><p>Body of the page with many words in it.</p><p>And more of them here.</p><label>Your name</label><button>Send</button><select><option>a</option></select></div></form></body>'
    assert html.main_text(page) == "Title\n\nBody of the page with many words in it.\n\nAnd more of them here."
    small = "<body><div><p>Body of the page with many words in it.</p><p>And more of them here.</p></div><form><p>Search us</p><input></form></body>"
    assert html.main_text(small) == "Body of the page with many words in it.\n\nAnd more of them here."


def test_what_a_host_repeats_inside_its_articles_stays(spark):
    page = '<body><nav>menu</nav><article><p>Subscribe now</p><h1>Dish {0}</h1><h2>Ingredients</h2><ul><li>Thing {0}</li><li>Salt</li></ul><p>Advertisement</p><h2>Method</h2><p>Cook {0} well.</p><p>All rights reserved</p></article></body>'
    rows = [(i, f"http://dishes/{i}", page.format("abcdefgh"[i] * (i + 1))) for i in range(6)]
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        x = "abcdefgh"[r["page_id"]] * (r["page_id"] + 1)
        assert r["text"] == f"Dish {x}\n\nIngredients\n\nThing {x}\n\nSalt\n\nMethod\n\nCook {x} well."


@pytest.mark.parametrize("second", ["post", "other", ""])
def test_two_articles_whatever_their_class(second):
    page = f'<body><main><article class="post"><p>First one of some length here.</p></article><article class="{second}"><p>Second.</p></article><article class="related promo"><p>Buy this.</p></article></main></body>'
    assert html.main_text(page).split("\n\n") == ["First one of some length here.", "Second."]


def test_the_wrapper_decides_where_no_tag_or_name_does(spark):
    """Two columns of one kind: what stays the same on all pages of the host is the site's, though it is longer."""
    same = "These same words stand on each page of this host and are much longer than what the page itself has to say about anything."
    page = '<body><div class="x"><div class="q">' + same + '</div></div><div class="y"><div class="q">Own words of page {0}.</div></div></body>'
    rows = [(i, f"http://h/{i}", page.format("abcdefgh"[i] * 3)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own words of page {'abcdefgh'[i] * 3}." for i in range(6)}
    assert html.main_text(rows[0][2]) == same  # without the host's wrapper the page alone cannot tell
