import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pelagia.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body class="has-nav"><header><h1>Site</h1></header>
<nav><ul><li><a>m</a></ul></nav><div class="cookie-notice">We use cookies</div><main><div class="breadcrumbs">a &gt; b</div>
<article class="post"><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>&nbsp;para<br>two<p>Second &#8212; x
<aside>pull</aside><div class="ad">Buy</div><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><script>var a="</p><p>no";</script>
<form><input><button>Go</button></form><footer>by me</footer></article><section id="comments"><article class="comment">great</article></section>
<div class="related-posts">r</div></main><div id="sidebar">side</div><footer>&copy; x</footer></body></html>"""


def test_article_without_the_rest():
    assert H.main_text(PAGE) == "Title & more\n\nFirst bold para two\n\nSecond — x\n\none\n\ntwo\n\nc1\n\nc2"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<div>x < y & z</div><!-- c --><p>q", "x < y & z\n\nq"),
        ("<p>un<b>closed", "unclosed"), ("<!-- never closed <p>x", ""), ("<script>never", ""), ("a<br/>b<hr>c", "a b\n\nc"),
        ("<body><form><article>in form</article></form>", "in form"), ("<div hidden>h</div>ok", "ok"), ("<p>&lt;b&gt; x</p>", "<b> x"),
        ("<p>" + "w " * 50_000 + "</p>", ("w " * 50_000).strip()),
    ],
)
def test_pages(page, text):
    assert H.main_text(page) == text


def test_generated_pages(spark):
    """Against the generator's own layout, read with plain patterns."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n\n".join(x for x in blocks if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def site(n=12):
    """Pages without an article element: a template line, and a text of each page's own."""
    return [(i, f"http://a.example/{i}", f"<body><div class=c>Same slogan everywhere</div><div class=t><p>Story {i} of its own.</p></div><i>x</i></body>") for i in range(n)]


SCHEMA = "page_id LONG, url STRING, html STRING"


def test_template_text_goes(spark):
    rows = site() + site()[:3] + [(100, "http://b.example/", site()[0][2]), (None, None, None), (101, None, "<p>alone")]
    got = H.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in got if r.url and "a.example" in r.url) == sorted(f"Story {r[0]} of its own." for r in site() + site()[:3])
    assert [r.text for r in got if r.page_id == 100] == ["Same slogan everywhere\n\nStory 0 of its own.\n\nx"]  # too few pages to judge
    assert [r.text for r in got if r.page_id is None] == [""] and [r.text for r in got if r.page_id == 101] == ["alone"]
    shuffled = H.extract(spark.createDataFrame(rows, SCHEMA), broadcast_bytes=0).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got))


def test_template_text_inside_main_and_article_goes(spark):
    for tag in ("main", "article"):
        framed = [(i, u, h.replace("<body>", f"<body><{tag}>").replace("</body>", f"</{tag}></body>")) for i, u, h in site()]
        got = H.extract(spark.createDataFrame(framed, SCHEMA)).collect()
        assert sorted(r.text for r in got) == sorted(f"Story {i} of its own." for i in range(12))


def test_article_of_template_paths_only_stays(spark):
    same = [(i, f"http://a.example/{i}", f"<body><nav>{i}</nav><article><p>One story.</p></article></body>") for i in range(8)]
    assert {r.text for r in H.extract(spark.createDataFrame(same, SCHEMA)).collect()} == {"One story."}


def test_article_parts_with_telling_names_stay():
    """A class or id that holds a word of noise among others is not noise; one that is made of such words is."""
    page = "<article><p>a</p><div class='social-history'><p>b</p></div><section id='related-work'><p>c</p></section><div class='ad-box'>x</div><ul class='socialShare'><li>y</ul></article>"
    assert H.main_text(page) == "a\n\nb\n\nc"


def test_the_tree_finds_the_main_branch(spark):
    """Generated pages with the article element's name taken away: priors alone don't know where the text is."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url like '%blog.tionsh%'")
    bare = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    bare = bare.withColumn("html", F.regexp_replace("html", "<nav>", "<div><i>Same words</i>"))
    want = {r.page_id: r.text for r in H.extract(pages).collect()}
    got = {r.page_id: r.text for r in H.extract(bare).collect()}
    alone = {r.page_id: H.main_text(r.html) for r in bare.collect()}
    assert len(want) > 300 and sum(alone[k] == t for k, t in want.items()) == 0
    # the menu's words that differ from page to page may stay; what is the same goes
    assert all(got[k].endswith(t) and "Same words" not in got[k] for k, t in want.items())


def test_rare_paths_have_their_branchs_importance(spark):
    """A template box with one odd line a page, in an element of its own name each time, goes with the box."""
    def page(k):
        odd = f"<p class=r{'abcdefghijklmnopqrst'[k]}>Line {k}</p>"
        return f"<body><div class=x><p>Same</p><p class=s>Always</p>{odd}</div><div class=y><p>{f'Story {k} goes on. ' * 20}</p></div></body>"

    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(20)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: (f"Story {k} goes on. " * 20).strip() for k in range(20)}


def brute_tree(rows):
    """Per path: pages, presentation, content, chars, prior; and per branch composed and mass."""
    pages, styles, texts, size, up, prior = defaultdict(int), defaultdict(Counter), defaultdict(Counter), {}, {}, {}
    for _, _, page in rows:
        p = H.parse(page)
        kids = defaultdict(set)
        for n in p.nodes[1:]:
            kids[n.path].add(tuple(a for a, b in zip(n.kids, [None, *n.kids]) if a != b))
        for path, looks in kids.items():
            pages[path] += 1
            styles[path][frozenset(looks)] += 1
        for path, text in {(p.nodes[k].path, t) for k, t in p.blocks}:
            texts[path][text] += 1
        for k, n in enumerate(p.nodes[1:], 1):
            up[n.path] = p.nodes[n.parent].path if n.parent else None
            prior[n.path] = H.priors(p)[0][k]
    tree = {}
    for path, m in pages.items():
        look = -sum(k / m * math.log(k / m, m) for k in styles[path].values()) if m > 1 else 1.0
        said = 1 - sum(math.log(k, m) for k in texts[path].values()) / len(texts[path]) if texts[path] and m > 1 else 1.0 if texts[path] else None
        size[path] = sum(k * len(t) for t, k in texts[path].items())
        tree[path] = (m, look, said, size[path], prior[path])
    walk, mass = defaultdict(lambda: [0.0, 0.0]), defaultdict(float)
    for path, (m, look, said, chars, p) in tree.items():
        if said is not None:
            own, far, above = max(said, look * H.PRESENTATION), 1, up[path]
            while above is not None:
                walk[above][0] += H.GOES_ON**far * m * own
                walk[above][1] += H.GOES_ON**far * m
                mass[above] += chars * own * p
                far, above = far + 1, up[above]
    return tree, {k: a / b for k, (a, b) in walk.items()}, mass


def test_tree_against_brute_force(spark):
    rows = site(7) + [(50, "http://a.example/z", "<body><div class=c>Another</div><nav><ul><li>one</li><li><p>two</p></li></ul></nav><div class=t><div><p>Deep</p></div></div></body>")]
    found = H.style_rows(spark.createDataFrame(rows, SCHEMA))
    got = {(r.host, r.path): r for r in H.importance(found).collect()}
    tree, composed, mass = brute_tree(rows)
    assert {k for _, k in got} == {H.signed(k) for k in tree}
    for path, (m, look, said, chars, prior) in tree.items():
        r = got["a.example", H.signed(path)]
        assert (r.pages, r.chars, r.prior) == (m, chars, prior)
        assert math.isclose(r.presentation, look, abs_tol=1e-9) and (r.content is None) == (said is None) and math.isclose(r.content or 0, said or 0, abs_tol=1e-9)
    above = found.where(F.col("kind") == H.ANCESTOR).select("host", "path", F.col("feature").alias("up"), F.col("size").alias("far"))
    inner = {r.path: r for r in H.composed(H.importance(found), above).collect()}
    assert {H.signed(k) for k in composed} == set(inner) and len(inner) > 5
    for path, c in composed.items():
        assert math.isclose(inner[H.signed(path)].composed, c, abs_tol=1e-9) and math.isclose(inner[H.signed(path)].mass, mass[path], abs_tol=1e-6)


def test_empty_and_clashing(spark):
    assert H.extract(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame(site(), SCHEMA).withColumns({n: F.lit("x") for n in ("text", "host", "paths", "n_chars")})
    assert H.extract(rows).columns == ["page_id", "url", "text", "n_chars"]
