"""Scalar functions (F1-F21) on the reference's own unit-test cases."""

from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions import urls as U


def one(spark, fn, values, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col(df.columns[0]))).collect()]


def test_slugify(spark):
    got = one(spark, X.slugify, ["Hello World", "What is C++?", "foo__bar--baz", "---hello---", "", "Niño  --x"])
    assert got == ["hello-world", "what-is-c", "foo-bar-baz", "hello", "", "nio-x"]


def test_best_srcset(spark):
    got = one(spark, X.best_srcset, ["small.jpg 320w, large.jpg 1024w", "normal.jpg 1x, retina.jpg 2x", "only.jpg", ""])
    assert got == ["large.jpg", "retina.jpg", "only.jpg", None]


def test_first_non_empty(spark):
    df = spark.createDataFrame([(None, "", "  ", "hello", "world"), (None, "", "  ", None, None),
                                ("  trimmed  ", None, None, None, None)], "a string, b string, c string, d string, e string")
    got = [r[0] for r in df.select(X.first_non_empty("a", "b", "c", "d", "e")).collect()]
    assert got == ["hello", None, "trimmed"]


def test_escape_yaml(spark):
    got = one(spark, X.escape_yaml, ['say "hello"', "path\\to", "a\nb\tc\rd"])
    assert got == ['say \\"hello\\"', "path\\\\to", "a\\nb\\tc\\rd"]


def test_escape_info_string(spark):
    assert one(spark, X.escape_info_string, ['title="hello"']) == ['title=\\"hello\\"']


def test_post_process(spark):
    got = one(spark, X.post_process_markdown, ["a\n\n\n\nb", "“quoted” ‘single’", "hello world", "hello   \nworld   "])
    assert got == ["a\n\nb", "\"quoted\" 'single'", "hello world", "hello\nworld"]


def test_strip_front_matter(spark):
    df = spark.createDataFrame([("---\ntitle: Hello\n---\nBody text",), ("Just content",),
                                ("---\ntitle: Hello\nNo closing",)], "s string")
    got = [tuple(r) for r in df.select(X.strip_front_matter("s").alias("r")).select("r.*").collect()]
    assert got == [("---\ntitle: Hello\n---", "Body text"), (None, "Just content"),
                   (None, "---\ntitle: Hello\nNo closing")]


def test_trim_fence_padding(spark):
    got = one(spark, X.trim_fence_padding, ["\n\ncode here\n\n", "\na\n\nb\n", "\r\ncode\r\n"])
    assert got == ["code here", "a\n\nb", "code"]


def test_front_matter_and_output(spark):
    df = spark.createDataFrame([('Test "Title"', "https://example.com", "Jane", "A test page",
                                 "2025-01-01T00:00:00.000Z")], "t string, s string, a string, d string, r string")
    fm = df.select(X.build_front_matter("t", "s", "a", "d", "r")).first()[0]
    assert 'title: "Test \\"Title\\""' in fm and fm.startswith("---\n") and fm.endswith("\ntoc: true\n---")
    out = spark.createDataFrame([("FM", "- [A](#a)", "Body"), ("FM", "  ", "Body")], "f string, t string, c string")
    a, b = [r[0] for r in out.select(X.build_output("f", "t", "c")).collect()]
    assert "## Table of Contents" in a and b.endswith("\n---\n\nBody") and "Table of Contents" not in b


def test_strip_tracking_and_resolve(spark):
    df = spark.createDataFrame([("https://example.com/page?utm_source=twitter&keep=1",),
                                ("https://example.com/?fbclid=abc&gclid=def",), ("#section",),
                                ("javascript:void(0)",), ("/für",)], "h string")
    got = [r[0] for r in df.select(U.clean_href(F.col("h"), F.lit("https://Example.com/base/x?q=1"))).collect()]
    assert got == ["https://example.com/page?keep=1", "https://example.com/", "#section", "javascript:void(0)",
                   "https://example.com/f%C3%BCr"]


def test_decode_entities(spark):
    got = one(spark, X.decode_entities, ["a &amp; b &copy; &#252; &#xFC; &amp;lt;"])
    assert got == ["a & b © ü ü &lt;"]


def test_sql_functions(spark):
    from pyspark.sql import functions as F

    from pagemill.functions import sql, text
    assert "slugify" in sql.register_functions(spark)
    rows = spark.createDataFrame([(" Héllo  Wörld_x ",), ('a\\b"c\n\td',), ("[12px]",), ("\r\n \n x\n\n",), ("",), (None,)], "s string")
    for name in sql.FUNCTIONS:
        column = {"squash_title": text.squash_ws}.get(name) or getattr(text, name)
        both = rows.select(F.expr(f"{name}(s)").alias("got"), column("s").alias("want")).collect()
        assert [r.got for r in both] == [r.want for r in both], name


def test_trim_takes_white_space_of_both_ends_only(spark):
    """A next-line character is no white space here; what stands before it stays."""
    from pagemill.functions.sql import register_functions
    from pagemill.functions.text import WS, WS_CHARS, trim_ws

    register_functions(spark)
    given = ["", " ", " a b\t", "\u3000x\ufeff\n", "a \u0085", "\u2028\u00a0", "\u200b y", None]
    df = spark.createDataFrame([(x,) for x in given], "s string")
    rows = df.select(trim_ws("s").alias("a"), F.expr("trim_ws(s)").alias("b")).collect()
    want = ["", "", "a b", "x", "a \u0085", "", "\u200b y", None]
    assert [r.a for r in rows] == want and [r.b for r in rows] == want
    all_of_them = spark.createDataFrame([(c,) for c in map(chr, range(1, 0xD800))] + [("\ufeff",)], "c string")
    assert sorted(r.c for r in all_of_them.where(F.col("c").rlike(f"^[{WS}]$")).collect()) == sorted(WS_CHARS)
