"""Block rendering and what cleaning must not lose: exact Markdown of small pages."""

import pytest

URL = "https://h.example/a/b/c/d/"

PAGES = [
    ("<blockquote><p>Quoted one</p><p>Quoted two</p></blockquote><blockquote>Next</blockquote><p>after</p>",
     "> Quoted one\n>\n> Quoted two\n\n> Next\n\nafter"),
    ("<ul><li><p>item a</p></li><li><p>item b</p><p>more b</p></li></ul>", "-   item a\n\n-   item b\n\n    more b"),
    ("<ul><li>a</li><li>b<ol><li>c</li><li>d</li></ol></li></ul>", "-   a\n-   b\n    1.  c\n    2.  d"),
    ("<blockquote><p>q</p><ul><li>x</li><li>y</li></ul></blockquote>", "> q\n>\n> -   x\n> -   y"),
    ("<ul><li>x<blockquote>q<br>r</blockquote></li></ul>", "-   x\n\n    > q\n    > r"),
    ("<h2>\n Title\n</h2><p>\n Hello\n <b>you</b> </p>", "## Title {#title}\n\nHello **you**"),
    ("<p>Use <code>my_func[0]</code> and a_b</p>", "Use `my_func[0]` and a\\_b"),
    ('<p><a href="">e</a> <a href="javascript:alert(1)">c</a> <a href="java\tscript:x">d</a> <a href="https://x.org/">f</a></p>',
     "e c d [f](https://x.org/)"),
    ("<p>a</p><pre>plain pre</pre><p>b</p>", "a\n\nplain pre\n\nb"),
    ("<p>one</p><script >x</script ><p>two</p><script>y</script>", "one\n\ntwo"),
    ('<p>x</p><iframe class="lead-video" src="https://www.youtube.com/embed/abc"></iframe>',
     "x\n\n> Embedded iframe — from youtube.com — https://www.youtube.com/embed/abc"),
    ("<p>caf&eacute; &rarr; &uuml; &#38;lt; &amp;amp; &#x41;</p>", "café → ü &lt; &amp; A"),
    ("<table><tr><td>1<table><tr><td>x</td></tr></table>y</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table><p>z</p>",
     "| 1 x y | 2 |\n| --- | --- |\n| 3 | 4 |\n\nz"),
    ('<p>a</p><a href="/x"><svg width="16" height="16"><title>t</title></svg></a><ul><li><svg width="9" height="9"></svg></li></ul>'
     '<h2><svg width="20" height="20"></svg></h2><p>b</p>', "a\n\nb"),
    ('<h3 id="n">Name</h3><div data-rehype-pretty-code-figure aria-labelledby="n"><i data-language="Go">g</i><button>Copy</button>'
     "<pre><button>C</button><code>x = 1</code></pre></div>", '### Name {#n}\n\n_g_\n\n``` go title="Name"\nx = 1\n```'),
    ('<ol start="3"><li>a</li><li>b<ul><li>c</li></ul></li></ol>', "3.  a\n4.  b\n    -   c"),
    ('<p>p</p><img src="javascript:x" alt="i"><iframe src="java\tscript:y"></iframe><img src="data:image/png;base64,AA" alt="d">',
     "p\n\n> Embedded iframe\n\n![d](data:image/png;base64,AA)"),
    ("<p>say “hi”</p><pre><code>x = “y”\n\n\n\nend  \n</code></pre><p>a\u00a0b</p>", 'say "hi"\n\n```\nx = “y”\n\n\n\nend  \n```\n\na b'),
    ("<blockquote><pre><code>a\n\nb</code></pre></blockquote>", "> ```\n> a\n>\n> b\n> ```"),
    ("<pre>\nfirst  line\n    second *x*\n# third\n</pre><p>b</p>", "first  line\n    second \\*x\\*\n\\# third\n\nb"),
    ("<p>use <code>a`b</code> or <code>``</code></p>", "use ``a`b`` or ` `` `"),
    ("<p># x</p><p>1. x</p><p>- x</p><p>+ x</p><p>&gt; q</p><p>a<br># b</p><p>===</p><p>~~~</p>",
     "\\# x\n\n1\\. x\n\n\\- x\n\n\\+ x\n\n\\> q\n\na\n\\# b\n\n\\===\n\n\\~~~"),
    ("<p><span># x</span> <b># y</b></p><p>-5 and +5, 3.14, #tag</p><h2># t</h2>", "\\# x **# y**\n\n-5 and +5, 3.14, #tag\n\n## # t {#t}"),
    ("<ul><li><input type='checkbox' checked> done</li><li><input type=checkbox>open</li><li>none</li></ul><p><input type=checkbox>no</p>",
     "-   [x] done\n-   [ ] open\n-   none\n\nno"),
    ("<table><tr><td>x <a href='/l'>l <b>k</b></a><br><code>p|q</code></td><td><img src='/i.png' alt='pic'><p>a*b</p><p>c</p></td></tr></table>",
     "| x [l **k**](https://h.example/l) `p\\|q` | ![pic](https://h.example/i.png) a\\*b c |\n| --- | --- |"),
    ("<p>A<sup><a href='#n'>1</a></sup></p><div id='n'><p>Note <a href='/l'>link</a></p><p>- more</p> <a href='#fnref1'>back</a></div>",
     "A[^1]\n\n[^1]: Note [link](https://h.example/l) - more"),
    ("<table><tr><td>c<sup><a href='#n'>1</a></sup></td></tr></table><p id='n'># note</p>", "| c[^1] |\n| --- |\n\n[^1]: \\# note"),
    ("<p><del>a</del> <s>b</s></p>", "~~a~~ ~~b~~"),
    ('<div data-demo><p role="tab" aria-selected="true">App</p><div role="figure"><button>Run</button><pre><code>y</code></pre></div></div>',
     'App\n\n``` title="App"\ny\n```'),
]


@pytest.fixture(scope="module")
def bodies(convert):
    c = convert([(i, URL, f"<main>{html}</main>") for i, (html, _) in enumerate(PAGES)])
    return {r.page_id: r.body for r in c.body.collect()}


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_body(bodies, i):
    assert bodies[i] == PAGES[i][1]


LINKS = [
    ("../../../../x", "https://h.example/x"), ("/a/b/c/d/e/../../../../../x", "https://h.example/x"), ("../../../../../..", "https://h.example/"),
    ("./x/./y/.", "https://h.example/a/b/c/d/x/y/"), ("x/..", "https://h.example/a/b/c/d/"), ("%2e%2E/x", "https://h.example/a/b/c/x"),
    ("..x/...", "https://h.example/a/b/c/d/..x/..."), ("/a//../b", "https://h.example/a/b"),
]


def test_dot_segments(spark):
    from pyspark.sql import functions as F

    from pagemill.functions.urls import resolve_url
    rows = spark.createDataFrame(LINKS, "href string, want string").withColumn("got", resolve_url(F.col("href"), F.lit(URL)))
    assert [(r.href, r.got) for r in rows.collect()] == LINKS


def test_rule_edits_survive_batches(spark, tmp_path):
    from pagemill.sources import rules as R
    from pagemill.streaming.stream import custom_rules, effective_rules, stream_rules
    log, table, ck = (str(tmp_path / n) for n in ("log", "rules", "ck"))

    def batch(*rows):
        spark.createDataFrame(rows, R.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(log)
        stream_rules(spark, log, table, ck, R.LOG_SCHEMA).awaitTermination()
        return {r.domain: r.selector for r in custom_rules(spark, table).collect()}

    assert {r.origin for r in R.fold_rules(R.builtin_rules(spark), spark.createDataFrame([], R.LOG_SCHEMA)).collect()} == {"builtin"}
    assert batch((0, "upsert", "a.org", "main", None), (5, "upsert", "c.org", "#new", None)) == {"a.org": "main", "c.org": "#new"}
    assert batch((6, "upsert", "b.org", "article", None)) == {"a.org": "main", "b.org": "article", "c.org": "#new"}
    assert batch((3, "upsert", "c.org", "#late", None), (7, "delete", "a.org", None, None)) == {"b.org": "article", "c.org": "#new"}
    assert batch((4, "upsert", "a.org", "#older than the delete", None)) == {"b.org": "article", "c.org": "#new"}
    assert batch((8, "reset", None, None, None), (9, "upsert", "dev.to", "#mine", None)) == {"dev.to": "#mine"}
    assert batch((2, "upsert", "old.org", "#before the reset", None)) == {"dev.to": "#mine"}
    assert {r.domain: r.selector for r in effective_rules(spark, table).collect()}["dev.to"] == "#mine"


def test_replayed_page_batch_is_written_once(spark, tmp_path):
    import shutil

    from pagemill.streaming.stream import stream_convert
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.createDataFrame([(1, URL, "<main><p>one</p></main>")], "page_id long, url string, html string").write.parquet(src)
    stream_convert(spark, src, out, ck).awaitTermination()
    shutil.rmtree(ck)  # the batch is run again, as after a lost commit
    stream_convert(spark, src, out, ck).awaitTermination()
    assert [r.page_id for r in spark.read.parquet(out).collect()] == [1]
