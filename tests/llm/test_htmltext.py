"""Main text of hand-written pages."""

from aqspark.llm import htmltext

TEXT = "A paragraph that is long enough to be the text of a page, with several words in it."
CASES = {
    f"<html><head><title>t</title></head><body><nav><a>Home</a></nav><article><h1>Head</h1><p>{TEXT}</p><p>Short.</p></article><footer>&copy; x</footer></body></html>": f"Head\n{TEXT}\nShort.",
    f'<div class="sidebar"><p>{TEXT} side</p></div><div id="content"><h1>Hi</h1><p>{TEXT}</p></div><div class="comments"><p>{TEXT}</p></div>': f"Hi\n{TEXT}",
    '<script>var t="</p><article>";</script><style>p{}</style><p>only &amp;amp; text&nbsp; here</p>': "only &amp; text here",
    f"<article><p><b>{TEXT}<br><p>second\n  line</article>": f"{TEXT}\nsecond line",
    f'<article><p>{TEXT}</p><div class="ad">buy</div><aside>s</aside><form>f</form><p>tail</p></article>': f"{TEXT}\ntail",
    f'<div class="ad">never closed<article><p>{TEXT}</p></article>': TEXT,
    f'<article><p>{TEXT}</p></article><article class="comment"><p>{TEXT} troll</p></article>': TEXT,
    '<p title="a > b">x &lt; y</p><!-- <p>no</p> --><p>1 < 2</p>': "x < y\n1 < 2",
    "plain": "plain", "": "", "<nav>menu</nav>": "", "<p>a<": "a<",
}


def test_pages_without_landmarks():
    long = f"<p>{TEXT}</p><p>{TEXT} again</p>"
    want = f"{TEXT}\n{TEXT} again"
    for wrapper in ('class="content has-sidebar"', 'id="page" class="site no-comments"', 'class="layout sidebar-right"', 'class="article-body share-enabled"', 'class="sidebar"'):
        assert htmltext.main_text(f"<body><nav>Home</nav><div {wrapper}>{long}</div><footer>end</footer></body>") == want
    assert htmltext.main_text(f'<article><div class="article-body share-enabled">{long}</div></article>') == want
    assert htmltext.main_text(f'<div><p>A <span class="search-hit">found</span> word. {TEXT}</p></div>') == f"A found word. {TEXT}"
    assert htmltext.main_text(f'<body><div class="post"><h1>Title</h1><div class="share">x</div>{long}<div class="ad">buy</div><p>Tail</p></div></body>') == f"Title\n{want}\nTail"
    for side in ('class="sidebar"', 'class="left-sidebar"', 'id="comments-list"', 'class="share-buttons"', 'class="pageFooter"'):
        assert htmltext.main_text(f"<div {side}><p>{TEXT} side</p></div><div>{long}</div>") == want


def test_cases(spark):
    pages = list(CASES) + [None, "<p>" + "w " * 300_000 + "</p>", "<div>" * 5000 + "deep"]
    df = spark.createDataFrame([(k, "u", h, "old", 1) for k, h in enumerate(pages)], "page_id bigint, url string, html string, text string, n_chars int")
    out = htmltext.extract(df)
    assert out.columns == ["page_id", "url", "n_chars", "text"]
    got = {r.page_id: r.text for r in out.collect()}
    assert [got[k] for k in range(len(pages))] == [*CASES.values(), "", " ".join(["w"] * 300_000), "deep"]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
        assert htmltext.main_text(r.html) == "\n".join(b for b in blocks if b)
