"""Conversion of small pages: removals, links, headings, contents, alternates, the sink."""

from pyspark.sql import functions as F

URL = "https://example.com/a/page"


def test_removals(convert):
    """Fixed selectors, a caller's selector, hidden and empty elements, unsafe elements, small images: one page each."""
    pages = [
        "<main><nav><a href='/m'>Menu</a></nav><p>Rivers rise in spring.</p><footer>Imprint</footer></main>",
        "<main><p>Rivers rise.</p><section class='teaser wide'>Read on</section></main>",
        "<main><p>seen</p><ul hidden><li>a</li></ul><span aria-hidden='true'>b</span><div style='color:red;display:none'>c</div></main>",
        "<main><p>seen</p><template><p>t</p></template><object data='/o.swf'><h2>old browser</h2></object></main>",
        "<main><div><p> </p><section><img src='/map.png' alt='map'></section></div></main>",
        "<main><p>seen</p><img src='/dot.png' width='31' height='1' alt='dot'></main>",
    ]
    c = convert([(i, URL, html) for i, html in enumerate(pages)], extra_remove=(".teaser", "ul > li"))
    found = {r.page_id: r.body for r in c.body.collect()}
    assert found == {0: "Rivers rise in spring.", 1: "Rivers rise.", 2: "seen", 3: "seen", 4: "![map](https://example.com/map.png)", 5: "seen"}
    assert {r.selectors for r in c.unsupported.collect()} == {"ul > li"} and c.unsupported.count() == len(pages)


def test_links_headings_and_contents(convert):
    c = convert([
        (1, URL, "<main><p><a href='/list?fbclid=7&amp;page=3'>List</a> and <a href='../b/c'>a file</a>, <a href='#top'>top</a>, "
                 "<a href='javascript:go()'>go</a></p></main>"),
        (2, URL, "<main><h2><a href='/rivers'>All rivers</a></h2><h3><a href='/r'>Rhine</a> <em>upper</em></h3></main>"),
        (3, URL, "<main><h1>Rivers</h1><h2>Source</h2><h3>Snow</h3><h2>Source</h2><h2>Source</h2><h2 id='the-sea'>Mouth</h2><p>x</p></main>"),
    ])
    assert {r.text: r.href_clean for r in c.links.collect() if r.page_id == 1} == {
        "List": "https://example.com/list?page=3", "a file": "https://example.com/b/c", "top": "#top", "go": "javascript:go()"}
    bodies = {r.page_id: r.body for r in c.body.collect()}
    assert bodies[1] == "[List](https://example.com/list?page=3) and [a file](https://example.com/b/c), [top](#top), go"
    assert bodies[2] == "## All rivers {#all-rivers}\n\n### [Rhine](https://example.com/r) _upper_ {#rhine-upper}"
    assert {r.page_id: r.toc for r in c.toc.collect()}[3].split("\n") == [
        "- [Rivers](#rivers)", "  - [Source](#source)", "    - [Snow](#snow)", "  - [Source](#source-1)", "  - [Source](#source-2)", "  - [Mouth](#the-sea)"]


def test_selectors_with_commas_and_unsupported_ones(spark):
    from pagemill.operators import select as S
    rules = spark.createDataFrame([("*", 0, "[a='x,y'], b[c=\"],\"].d,e > f"), ("*", 1, "p:empty"), ("*", 2, "")], S.RULE_SCHEMA)
    got = {(r.rule_ord, r.alt, r.key, r.op, r.value) for r in S.conditions(rules).collect()}
    assert got == {(0, 0, "@a", "eq", "x,y"), (0, 1, "tag", "eq", "b"), (0, 1, "@c", "eq", "],"), (0, 1, ".", "eq", "d")}
    assert {(r.rule_ord, r.sel) for r in S.quarantine(rules).collect()} == {(0, "e > f"), (1, "p:empty"), (2, "")}


def test_pages_with_alternates_are_not_tokenised(spark, convert):
    from pagemill.plans.convert import Conversion
    link = "<link rel=alternate type='text/markdown' href='/a.md'>"
    pages = [
        (1, f"<head><title>One</title><!-- {link} --><meta name='author' content='W'>{link}</head><main><h2>gone</h2><p>gone</p></main>"),
        (2, f"<head><title>{link}</title></head><main><p title=\"{link}\">two</p><!-- {link} --></main>"),
        (3, f"<head><title>Three</title>{link.replace('/a', '/none')}</head><main><p>three</p></main>"),
    ]
    given = convert([(i, URL, html) for i, html in pages])
    alternates = spark.createDataFrame([("https://example.com/a.md", 200, "---\ntitle: x\n---\n\n# Published"), ("https://example.com/none.md", 404, "no")],
                                       "url string, status int, text string")
    c = Conversion(spark, given.corpus, alternates=alternates)
    docs = {r.page_id: (r.origin, r.body) for r in c.documents.collect()}
    assert docs == {1: ("canonical", "# Published"), 2: ("converted", "two"), 3: ("converted", "three")}
    assert [r.tok for r in c.corpus.tokens.where("page_id = 1").orderBy("pos").collect()] == ["<title>", "One", "</title>", "<meta name='author' content='W'>"]
    assert {r.page_id: (r.title, r.author) for r in c.page_meta.collect()}[1] == ("One", "W")


def test_documents_are_spread_with_the_partitions(spark, tmp_path):
    from pagemill.sources.sink import write_documents
    docs = spark.range(4000).selectExpr("id AS page_id", "'one.example.org' AS host", "'x' AS markdown")
    for parts, files in (("4", 8), ("1280", 20)):
        out, before = str(tmp_path / parts), spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            write_documents(docs, out)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        back = spark.read.parquet(out)
        assert back.count() == 4000 and 1 < len(back.inputFiles()) <= files
        assert parts == "4" or len(back.inputFiles()) > 8


def test_partition_count_independence(spark, convert):
    rows = [(i, f"https://s{i % 3}.example.org/p/{i}", f"<article><h1>T{i}</h1><p>p {i} <b>b</b></p></article>")
            for i in range(40)]
    c1 = convert(rows).documents.select("page_id", "markdown").orderBy("page_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        c2 = convert(rows).documents.select("page_id", "markdown").orderBy("page_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert c1 == c2


def test_sweep_keeps_expected(spark):
    from pagemill.functions.urls import url_host
    from pagemill.operators import select as S
    from pagemill.operators.clean import remove_selectors
    from pagemill.plans.corpus import Corpus
    pages = spark.createDataFrame([(1, URL, "<div>a</div></nav>k<nav>x<div>y</nav>z<div>w</div>"),
                                   (2, URL, "</div><nav>n<nav>m</nav>o</nav>keep</nav></nav><nav>q</nav>r")],
                                  "page_id long, url string, html string").withColumn("host", url_host(F.col("url")))
    c = Corpus(spark, pages)
    rules = spark.createDataFrame([("*", 0, "nav")], S.RULE_SCHEMA)
    kept = remove_selectors(c.tokens, c.elements_attrs, rules).filter("kind = 'text'")
    got = {}
    for r in kept.orderBy("pos").collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got == {1: ["a", "k", "z", "w"], 2: ["keep", "r"]}
