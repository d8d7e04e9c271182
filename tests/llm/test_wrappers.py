"""op5: wrappers by alignment, held against a plain reading of them as regular expressions."""

import random
import re

from tidelog.llm import html


def pattern(x: html.Group) -> str:
    """The expression as a pattern over streams written as <label> and </>."""
    if x.loop:
        # a turn in which each member may be absent, repeated
        return "(?:" + "|".join(pattern(k) for k in x.kids) + ")" + ("*" if x.optional else "+")
    return "(?:" + re.escape(f"<{x.label}>") + "".join(pattern(k) for k in x.kids) + "</>)" + "?" * x.optional


def plain(stream) -> str:
    return "<#root>" + "".join(f"<{t[1]}>" if t[0] == html.OPEN else "</>" for t in stream if t[0] != html.TEXT) + "</>"


def some_page(rng: random.Random, depth: int = 0) -> str:
    tags = ["div", "div class='a'", "div class='b'", "section", "p", "h2", "ul", "table"]
    out = []
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(tags)
        name = tag.split()[0]
        if name in ("p", "h2"):
            inner = "t"
        elif name == "ul":
            inner = "<li>x</li>" * rng.randrange(4)
        elif name == "table":
            inner = "<tr><td>1</td></tr>" * rng.randrange(3)
        else:
            inner = some_page(rng, depth + 1) if depth < 2 else ""
        out.append(f"<{tag}>{inner}</{name}>" * rng.choice((1, 1, 1, 2, 3)))
    return "".join(out)


def test_a_wrapper_matches_every_page_it_came_from():
    for seed in range(150):
        rng = random.Random(seed)
        streams = [html.tree(some_page(rng)) for _ in range(rng.randrange(1, 6))]
        parts = [html.folded(s) for s in streams]
        whole = parts[0]
        for x in parts[1:]:
            whole = html.aligned(whole, x)
        # parts of a host aligned before they are put together
        half = len(parts) // 2
        if half:
            left, right = parts[0], parts[half]
            for x in parts[1:half]:
                left = html.aligned(left, x)
            for x in parts[half + 1 :]:
                right = html.aligned(right, x)
            both = html.aligned(left, right)
        else:
            both = whole
        for w in (whole, both):
            assert html.read(html.written(w)) == w
            for s in streams:
                assert re.fullmatch(pattern(w), plain(s)), (seed, html.expression(w), plain(s))


def test_mismatches_become_groups_by_kind():
    def wrapper(*pages):
        parts = [html.folded(html.tree(p)) for p in pages]
        whole = parts[0]
        for x in parts[1:]:
            whole = html.aligned(whole, x)
        return html.expression(whole)

    three = "<div>a</div><div>b</div><div>c</div>"
    # streams that agree keep their places, though the siblings look alike
    assert wrapper(three, three) == "<#root><div>(#)</><div>(#)</><div>(#)</></>"
    assert wrapper(three, "<div>a</div>" * 5) == "<#root><div>(#)</>+</>"
    assert wrapper("<div>a</div><section>b</section>", "<div>a</div><aside>n</aside><section>b</section>") == "<#root><div>(#)</><aside>(#)</>?<section>(#)</></>"
    assert wrapper("<div>a</div><section>b</section>" * 2, "<div>a</div><section>b</section>" * 3) == "<#root>(<div>(#)</>?<section>(#)</>?)+</>"
    assert wrapper("<h1>t</h1><p>a</p><ul><li>x</ul><p>b</p>", "<h1>t</h1><p>a</p>") == "<#root><h1>(#)</>(<p>(#)</>?<ul><li>(#)</></>?)+</>"


def test_expressions_do_not_grow_with_pages():
    rng = random.Random(5)
    whole = html.folded(html.tree("<body></body>"))
    sizes = []
    for _ in range(400):
        kinds = [rng.choice(("div class='a'", "div class='b'", "section", "main", "fieldset")) for _ in range(rng.randrange(30))]
        page = "<body>" + "".join(f"<{k}><p>x</p></{k.split()[0]}>" for k in kinds) + "</body>"
        whole = html.aligned(whole, html.folded(html.tree(page)))
        sizes.append(len(html.written(whole)))
    assert sizes[-1] == sizes[200] and max(sizes) < 8000


def extracted(spark, pages):
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_the_place_alone_decides(spark):
    """Siblings without class or telling tag: the wrapper tells them apart by place and finds the one whose text differs."""
    same = "These words stand on each page of this host and are longer than what the page itself says about anything at all."
    own = ["abcdefgh"[i] * 3 for i in range(6)]
    got = extracted(spark, [f"<body><div><div>{same}</div></div><div><p>Own words {x}.</p></div><div><div>{same} Again.</div></div></body>" for x in own])
    assert got == {i: f"Own words {x}." for i, x in enumerate(own)}


def test_slots_outweigh_an_article_tag(spark):
    """An article element that is the same on every page holds no slot."""
    same = "A teaser of the site in an article element, the same words on each of its pages."
    own = ["abcdefgh"[i] * 3 for i in range(6)]
    pages = [f"<body><article><p>{same}</p></article><div><p>Own words {x}.</p><p>And more of {x}.</p></div></body>" for x in own]
    assert extracted(spark, pages) == {i: f"Own words {x}.\n\nAnd more of {x}." for i, x in enumerate(own)}
    assert html.main_text(pages[0]) == same  # without the host's wrapper


def test_ids_of_pages_do_not_split_a_host(spark):
    same = "These words stand on each page of this host and are longer than what the page itself says about anything at all."
    own = ["abcdefgh"[i] * 3 for i in range(6)]
    got = extracted(spark, [f"<body><div class='x' id='top-{x}'>{same}</div><div class='y' id='post-{x}'><p>Own words {x}.</p></div></body>" for x in own])
    assert got == {i: f"Own words {x}." for i, x in enumerate(own)}
