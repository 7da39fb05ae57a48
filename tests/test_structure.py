"""Tolerant pairing, raw-text elements and pages given more than once, as exact documents."""

URL = "https://example.org/a"

UNCLOSED = [
    ("<section><div class='ad-box'>ad</section><p>rest</p>", "rest"),
    ("<article><section><div class='ad-box'>ad<p>more</section><p>rest</p></article>", "rest"),
    ("<main><div><section><div class='ad-box'>ad</section><p>one</p></div><p>two</p></main>", "one\n\ntwo"),
    ("<main><div><section><div class='ad-box'>ad<section>in</section></section><p>one</p></div><p>two</p></main>", "one\n\ntwo"),
    ("<main><ul><li><div class='ad-box'>ad</li><li>x</li></ul><p>rest</p></main>", "-   x\n\nrest"),
    ("<main><nav><ul><li>m</nav><p>rest</p></main>", "rest"),
    ("<main><p>a</p><aside>no<div>no</aside>b<div>c</div></main>", "a\n\nb\n\nc"),
    ("<main><blockquote><p>q<div>r</blockquote><p>s</p></main>", "> q\n>\n> r\n\ns"),
]
RAW = [
    ("<main><textarea>no <div class='ad-x'> end</textarea><p>after</p></main>", "no <div class='ad-x'> end\n\nafter"),
    ("<main><p>a</p><iframe src='https://v.example.org/x' srcdoc=\"<p>'>\"><div class=ad-x></iframe><p>after</p></main>", "after"),
    ("<main><p>a</p><svg width=100 height=100><title/></svg><p>after</p></main>", "after"),
    ("<main><p>a</p><noembed><section></noembed><p>after</p></main>", "after"),
]


def bodies(convert, cases):
    """The bodies of all pages in one conversion."""
    rows = convert([(i, URL, html) for i, (html, _) in enumerate(cases)]).body.collect()
    return [r.body for r in sorted(rows, key=lambda r: r.page_id)]


def test_unclosed_ends_with_its_parent(convert):
    assert bodies(convert, UNCLOSED) == [text for _, text in UNCLOSED]


def test_raw_text_holds_no_markup(convert):
    found = bodies(convert, RAW)
    assert found[0] == RAW[0][1] and [b.endswith(text) for b, (_, text) in zip(found, RAW, strict=True)] == [True] * len(RAW)


def test_title_is_text_whatever_it_looks_like(convert):
    c = convert([(1, URL, "<title>a <b> & <!-- c</title><main><p>x</p></main>"), (2, URL, "<title></title><main><p>y</p></main>")])
    assert {r.page_id: r.title for r in c.page_meta.collect()} == {1: "a <b> & <!-- c", 2: ""}


def test_a_page_given_twice_is_one_document(spark):
    from pagemill.streaming.stream import convert_batch
    one, two = "<main><h2>A</h2><p>one</p></main>", "<main><h2>A</h2><p>two</p></main>"
    rows = [(50, URL, one), (50, URL, two), (50, URL, one), (51, URL, one), (51, URL, one), (None, URL, one), (None, None, two), (52, URL, None),
            (53, URL, "<!-- only -->")]
    got = convert_batch(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    known = {r.page_id: r for r in got if r.page_id is not None}
    assert len(got) == 6 and sorted(known) == [50, 51, 52, 53]
    assert known[50].body.endswith("two") and known[51].body.endswith("one")  # the greatest html; copies count once
    assert [(known[k].status, known[k].error, known[k].crawls) for k in sorted(known)] == [
        ("ok", None, 3), ("ok", None, 2), ("error", "page has no html", 1), ("error", "page has no content", 1)]
    assert [(r.status, r.error, r.markdown) for r in got if r.page_id is None] == [("error", "page has no id", None)] * 2


def test_the_latest_crawl_counts(spark):
    from pagemill.plans.convert import Conversion
    from pagemill.plans.corpus import Corpus
    rows = [(1, URL + "/z", "<main><p>old</p></main>", "2024-01-01 00:00:00"), (1, URL, "<main><p>new</p></main>", "2024-02-01 00:00:00"), (1, URL, "<p>none", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at string").selectExpr("page_id", "url", "html", "timestamp(at) AS crawled_at")
    docs = Conversion(spark, Corpus(spark, df)).documents.collect()
    assert [(r.url, r.body) for r in docs] == [(URL, "new")]


LONG = "A text that is long enough to count, with commas, and with more words than a menu has."


def test_pages_without_a_main_element_lose_their_menus(convert):
    menu = "<div><ul>" + "".join(f"<li><a href='/{i}'>Menu entry {i} that is long</a></li>" for i in range(5)) + "</ul></div>"
    cases = [
        (f"<body>{menu}<div><p>{LONG}</p><p>{LONG}</p></div>{menu}</body>", f"{LONG}\n\n{LONG}"),
        (f"<body><p>One.</p><div><p>{LONG}</p></div><div><p>{LONG}</p></div></body>", f"One.\n\n{LONG}\n\n{LONG}"),  # both halves are the body's
        ("<body><div><p>short</p></div><p>end</p></body>", "short\n\nend"),  # nothing scores: the body
        (f"<article><p>in</p></article><div><p>{LONG}</p></div>", "in"),  # a named element comes first
        (f"<div>{LONG}</div>x", f"{LONG}\n\nx"),  # no block scores, no body: the page
    ]
    assert bodies(convert, cases) == [text for _, text in cases]
