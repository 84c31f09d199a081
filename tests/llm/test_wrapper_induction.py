import random
import time

import pytest

from routelens.llm import wrapper_induction as wi


def text_of(html, template=()):
    root = wi.parse(html)
    return wi.main_text(root, set(template), wi.outline(root)[1])


def test_blocks_entities_and_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body class="page">
    <nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><header>Site</header>
    <article><h1>Head &amp; tail</h1><p>One<br>two&nbsp;three
    four<p><b>Five<br><p>six &lt;b&gt;</p><!-- no --><aside>side</aside><form><input value=x>Name</form>
    <div class="share-buttons">Share</div><section id="comments"><p>First!</p></section><ul><li>a<li>b</ul></article>
    <footer>&copy; x</footer></body></html>"""
    assert text_of(page) == "Head & tail\n\nOne two three four\n\nFive\n\nsix <b>\n\na\n\nb"


def test_odd_pages():
    assert text_of("") == "" and text_of("<p>") == "" and text_of("plain  text") == "plain text"
    assert text_of("<p>a</div></p>b<b>c") == "a\n\nbc"
    assert text_of("<p>x < y and <3</p>") == "x < y and <3"
    assert text_of("<script>never closed <p>a") == ""
    assert text_of('<p title="a>b">c</p>') == "c"
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text_of('<p title="a>b<p id=x">c</p>') == "c"
    assert text_of('<article class="post header-image"><p>a</p><article class="comment">x</article></article><article class="user-comment">y</article>') == "a"
    assert text_of("<main><p>in</p></main><p>out</p>") == "in"
    assert text_of("<p>" + "word " * 100_000 + "</p>") == ("word " * 100_000).strip()


def plain_size(a, b, i=0, j=0):
    """Simple tree matching by its definition."""
    if a.tags[i] != b.tags[j]:
        return 0
    x, y = a.children(i), b.children(j)
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(1, len(x) + 1):
        for q in range(1, len(y) + 1):
            m[p][q] = max(m[p - 1][q], m[p][q - 1], m[p - 1][q - 1] + plain_size(a, b, x[p - 1], y[q - 1]))
    return m[-1][-1] + 1


def test_alignment_is_largest():
    rng = random.Random(8)

    def tree(depth):
        tag = rng.choice(["div", "b", "i"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0)) + f"</{tag}>"

    for _ in range(200):
        a, b = (wi.outline(wi.parse(tree(3)))[0] for _ in range(2))
        pairs = wi.align(a, b)
        assert len(pairs) == plain_size(a, b)
        assert all(a.tags[i] == b.tags[j] for i, j in pairs)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert wi.unpack(wi.pack(a)) == a


def test_template_is_learnt_across_pages(spark):
    rows = []
    for i in range(8):
        rows.append((i, f"http://a.org/{i}", f"<html><body><div><p>Welcome to our site</p></div><div><p>Story number {i} here</p>{'<p>extra</p>' * (i % 3)}</div><div>All rights kept</div></body></html>", "x"))
    rows += [(20, "http://b.org/1", "<body><p>Lone page</p></body>", "x"), (21, None, None, "x"), (22, "nonsense", "<p>z</p>", "x")]
    rows += [(30 + i, f"http://copies.org/{i}", "<article><p>The same story</p></article>", "x") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in wi.extract(pages).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i].text == "\n\n".join([f"Story number {i} here"] + ["extra"] * (i % 3))
        assert got[i].n_chars == len(got[i].text)
    assert got[20].text == "Lone page" and got[21].text == "" and got[22].text == "z"
    assert all(got[30 + i].text == "The same story" for i in range(20))
    assert wi.extract(pages.limit(0)).count() == 0


def test_main_text_by_weight_and_whole_kinds():
    story = "The story goes on for quite a while here. " * 3
    assert text_of(f'<div class="post-body"><p>{story}</p></div><article><p>tiny card</p></article>') == story.strip()
    assert text_of(f'<nav><p>Home</p></nav><article><div class="side-by-side"><p>left</p></div><div class="social-history"><p>past</p></div><p>{story}</p></article>') == f"left\n\npast\n\n{story.strip()}"
    for kind in ("share-buttons", "site-footer", "cookie-notice", "comments", "nav", "post-comments", "sidebar left", "side", "related-posts-list ad-slot"):
        assert text_of(f'<p>{story}</p><div class="{kind}"><p>junk</p></div>') == story.strip()
    deep = "<div>" * 210 + "<nav><p>Home About</p></nav><p>Story</p>" + "</div>" * 210
    assert text_of(deep) == "Story"
    a, b = (wi.outline(wi.parse("<div>" * 3000 + f"<p>{x}</p>" + "<i>y</i>" * n))[0] for x, n in (("a", 1), ("b", 2)))
    assert len(wi.align(a, b)) == len(a.tags)
    assert wi.layout(wi.outline(wi.parse(""))[0]) == wi.layout(wi.outline(wi.parse("no element"))[0]) == 0


def test_votes_and_templates_equal_brute_force(spark):
    """Two layouts of one host, a first page without an element, an odd page, repeated rows."""
    rows = [(0, "http://a.org/none", None), (1, "http://a.org/odd", "<table><tr><td>Error 404</td></tr></table>")]
    for i in range(2, 30):
        notice = "<div><p>Read our terms</p></div>"
        rows.append((i, f"http://a.org/{i}", f"<body>{notice}<div><p>Story {i}</p><p>more {i * i}</p></div><div>Bottom line</div></body>"))
    for i in range(30, 50):
        rows.append((i, f"http://a.org/{i}", f"<body><section><h2>Shop</h2><ul><li>Item {i}</li></ul></section><section>Ship it</section></body>"))
    rows += [rows[5], rows[5]]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, layout int").repartition(3)
    outlines = wi._outlines(pages).cache()
    groups, templates = wi.induce(outlines)
    assert groups.select("group").distinct().count() == 2
    got = {(r.group, x.node): x.aligned for r in templates.collect() for x in r.nodes}
    want, packed = {}, {}
    for r in outlines.collect():
        packed.setdefault(r.layout, {}).setdefault(r.outline, r.page_id)
    member = {r.layout: r.group for r in groups.collect()}
    for group in set(member.values()):
        ref = wi.unpack(min(packed[group], key=lambda o: (packed[group][o], o)))
        votes = {}
        for layout, group_ in member.items():
            for own in packed[layout] if group_ == group else ():
                page = wi.unpack(own)
                for i, j in wi.align(ref, page):
                    if i and ref.tags[i] not in ("html", "body"):
                        n, equal = votes.get(i, (0, 0))
                        votes[i] = n + 1, equal + (ref.text[i] == page.text[j])
        want |= {(group, i): n for i, (n, equal) in votes.items() if n >= wi.OUTSIDE and equal >= wi.SHARE * n}
    assert got == want and got
    texts = {r.page_id: r.text for r in wi.extract(pages).collect()}
    assert texts[0] == "" and texts[1] == "Error 404"
    assert all(texts[i] == f"Story {i}\n\nmore {i * i}" for i in range(2, 30))
    assert all(texts[i] == f"Item {i}" for i in range(30, 50))
    assert wi.extract(pages).count() == len(rows)


def test_the_larger_part_is_the_text():
    story = "".join(f"<p>Sentence {i} of a long story.</p>" for i in range(20))
    card = "<article><h3>Read on</h3><p>A card of another page that has some words as well, but far fewer.</p></article>"
    assert text_of(f"<body><div class='story'>{story}</div>{card}</body>") == "\n\n".join(f"Sentence {i} of a long story." for i in range(20))
    assert text_of(f"<body><article>{story}</article><div>{card}</div><p>By the way.</p></body>").startswith("Sentence 0")


def test_headers_of_articles_stay():
    page = "<body><header>Site</header><article><header class='entry-header'><h1>Title</h1><p>By one</p></header><p>Text of it.</p><footer>Filed</footer></article></body>"
    assert text_of(page) == "Title\n\nBy one\n\nText of it."
    assert text_of("<body><div class='page-header'>Site</div><h1 class='post-header'>Title</h1><p>Text.</p></body>") == "Title\n\nText."


@pytest.mark.parametrize("part", [
    "<ins class='adsbygoogle'>x</ins>", "<div class='cookie-bar-v2'>x</div>", "<div class='promo-offer'>x</div>", "<div class='siteFooter'>x</div>",
    "<section id='discussion'><p>x</p></section>", "<div style='color: red; display:none'>x</div>", "<div aria-hidden='true'>x</div>",
])
def test_kinds_that_are_no_text(part):
    assert text_of(f"<body><p>Text that stays, {{display: none}} or not.</p>{part}</body>") == "Text that stays, {display: none} or not."


def test_words_that_only_look_like_kinds_stay():
    page = "<body><div class='story-v2'><p>One.</p></div><div id='offerings'>Two.</div><div style='display: block'>Three.</div><div class='discussion-of-results'>Four.</div></body>"
    assert text_of(page) == "One.\n\nTwo.\n\nThree.\n\nFour."


def test_long_lists_take_little_time():
    rng = random.Random(1)
    shapes = ["<li>a</li>", "<li><b>b</b></li>", "<li><i>c</i><b>d</b></li>", "<p>e</p>", "<li><i><b>f</b></i></li>"]
    pages = ["<ul>" + "".join(rng.choice(shapes) for _ in range(5000)) + "</ul>" for _ in range(2)]
    a, b = (wi.outline(wi.parse(p))[0] for p in pages)
    began = time.time()
    pairs = wi.align(a, b)
    assert time.time() - began < 10 and len(pairs) > 3000
    assert all(a.tags[i] == b.tags[j] for i, j in pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    top = [(i, j) for i, j in pairs if i in set(a.children(1)) and j in set(b.children(1))]
    assert [j for _, j in sorted(top)] == sorted(j for _, j in top)
    assert wi._in_order(a, a, a.children(1), a.children(1)) == [(i, i) for i in a.children(1)]
    began = time.time()
    wi.parse("<div>" * 3000 + "</span></q>" * 20_000)
    assert time.time() - began < 2


def test_long_lists_are_matched_as_short_ones(monkeypatch):
    rng = random.Random(8)
    shapes = ["<li>a</li>", "<li><b>b</b></li>", "<li><i>c</i><b>d</b></li>", "<p>e</p>", "<li><i><b>f</b></i></li>", "<li><b>g</b><u>h</u><b>i</b></li>"]
    for n in (3, 20, 75):
        pages = ["<ul>" + "".join(rng.choice(shapes) for _ in range(rng.randint(n // 2, n))) + "</ul>" for _ in range(2)]
        a, b = (wi.outline(wi.parse(p))[0] for p in pages)
        told = []
        for cells in (0, 1 << 30):
            monkeypatch.setattr(wi, "MATCH_CELLS", cells)
            told.append(sorted(wi.align(a, b)))
        assert told[0] == told[1]
