"""op4 on written pages, op5 against the library, op9 on written files."""

import public_tokenizers
import pytest

from pagemill.llm import html_text, licenses, tokens

from .conftest import SF, same

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies, please accept all of them now.</div>
%s<script>var x = "</p>"; if (a<b) {}</script><!-- <p>none</p> --><p>First&nbsp;one &amp; <b>bold</b>
 text &lt;here&gt; that is long enough for a surge of the sums over three lines.<p>Second <a href="x">linked</a> one, not closed, long enough as well.</p>
<ul><li>point one<li>point two</ul>%s<div class="sidebar"><p>Popular things that many people read, at some length, every day of the week.</p></div>
<section id="comments"><article class="comment"><p>I liked this very much, thank you for the long and good read, write more!</p></article></section>
<form><label>Mail</label><input name="m"></form><footer>&copy; me</footer></body></html>"""
BODY = """First one & bold text <here> that is long enough for a surge of the sums over three lines.
Second linked one, not closed, long enough as well.
point one
point two"""


@pytest.mark.parametrize("wrap", [("<article><h1>Title</h1>", "</article>"), ("<main><h1>Title</h1>", "</main>"), ('<div id="content"><h1>Title</h1>', "</div>")])
def test_article(wrap):
    assert html_text.main_text(PAGE % wrap) == "Title\n" + BODY


def test_short_article_is_kept():
    assert html_text.main_text("<nav><a>x</a></nav><div class=ad>Buy now, it is cheap and good and long, so long.</div><article><h1>Hi</h1><p>Ok.</article>") == "Hi\nOk."


@pytest.mark.parametrize("html", [None, "", "   ", "<script>x</script>", "<nav>menu</nav>", "<!-- a", "<style>p{}"])
def test_no_text(html):
    assert html_text.main_text(html) == ""


def test_malformed_and_large():
    assert html_text.main_text("<p>a<p>b</i></div>c") == "a\nb\nc"
    assert html_text.main_text("<div>" * 5_000 + "deep").endswith("deep")
    assert html_text.main_text('<a "' * 5_000) is not None
    big = "<article>" + "<p>some words here</p>" * 50_000
    assert html_text.main_text(big).count("\n") == 49_999


LONG = "It holds words enough for a surge of the sums over three lines, and then some more of them."


@pytest.mark.parametrize("html", [
    f"<html><head><title>x</title><body><article><p>{LONG}</p></article></body></html>",
    f"<html><head><title>x<body><article><p>{LONG}</p></article><svg><title>y</title></svg>",
    f"<head><meta charset=x><noscript><img src=x></noscript><p>{LONG}",
    f"<article><p>{LONG}<svg class=icon/></p></article>",
    f'<article><p><math/><svg viewBox="0"><title/><path d="x"/></svg>{LONG}</p></article>',
    f"<article><span><svg><path d=x></span><p>{LONG}</p></article>",
    f"<article><svg class=icon><g><p>{LONG}</p></article>",
    f"<article><div><select><option>one</div><p>{LONG}</p><div><object><p>no</p></div></article>",
    f"<article><svg><foreignObject><p>no</p></foreignObject></svg><template><p>no</p></template><p>{LONG}</p></article>",
    f'<article><iframe src="x" /><p>{LONG}</p></article><div><textarea>no</div>',
])
def test_raw_elements_end(html):
    assert html_text.main_text(html) == LONG


def test_many_unclosed_raw_elements():
    assert html_text.main_text("<title>" * 20_000 + "x") == ""
    assert html_text.main_text("<svg>" + "<g>" * 20_000 + "</x>" * 20_000) == ""


PARTS = [f"{i} {LONG}" for i in range(8)]
CARDS = "".join(f"<article class=card><h3><a href=x>Card {i}</a></h3><p>Teaser {i}.</p></article>" for i in range(3))


@pytest.mark.parametrize("wrap", [("<main>", "</main>"), ("<div>", "</div>")])
def test_teasers_do_not_replace_the_text(wrap):
    text = html_text.main_text(f"<body>{wrap[0]}{''.join(f'<p>{p}' for p in PARTS)}{wrap[1]}{CARDS}</body>")
    assert text.split("\n")[:8] == PARTS
    if wrap[0] == "<main>":
        assert text == "\n".join(PARTS)


def test_articles_of_a_list_stay():
    assert html_text.main_text(f"<main><p>Intro.</p>{''.join(f'<article><p>{p}</article>' for p in PARTS)}</main>") == "\n".join(PARTS)


@pytest.mark.parametrize("tag", ["article", "main"])
def test_link_lines_of_an_article_stay(tag):
    links = "".join(f"<li><a href=x>Reference {i}</a>" for i in range(5))
    html = f"<{tag}><h1><a href=x>Title</a></h1><ul>{links}</ul><p>{LONG}</p><ul>{links}</ul><p>End.</p><nav>no</nav><p><a href=x>Last</a></p></{tag}><p><a href=x>no</a></p>"
    lines = [f"Reference {i}" for i in range(5)]
    assert html_text.main_text(html) == "\n".join(["Title", *lines, LONG, *lines, "End.", "Last"])
    assert html_text.main_text(f"<{tag}><a href=x>Only a link</a></{tag}>") == "Only a link"


def wall(parts):
    return "".join(f"<p>{p}</p>" for p in parts)


@pytest.mark.parametrize("between", ["<aside><p>no<p>no<p>no<p>no</aside>", "<div class=related><ul><li>no<li>no<li>no<li>no</ul></div>"])
@pytest.mark.parametrize("around", ["<div id=text>%s</div>", "<body>%s", "%s", "<div><div>%s</div></div>"])
def test_removed_blocks_do_not_split_the_text(between, around):
    short = ["A short opening.", *PARTS * 5, "A short end."]
    html = wall(short[:1]) + between + wall(short[1:-1]) + between + wall(short[-1:])
    assert html_text.main_text(around % html) == "\n".join(short)


def test_link_lines_do_not_split_a_container():
    links, lines = "<ul>" + "<li><a href=x>Linked</a>" * 4 + "</ul>", ["Linked"] * 4
    menu = f"<div>{links}</div>"
    html = f"<body>{menu}<div>{wall(['Opening.'])}{links}{wall(PARTS * 5)}{links}{wall(['The end.'])}</div>{menu}</body>"
    assert html_text.main_text(html) == "\n".join(["Opening.", *lines, *PARTS * 5, *lines, "The end."])


def test_regions_of_links_go():
    links = "".join(f"<li>{i}. <a href=x>{LONG}</a>" for i in range(40))
    menu = "<a href=x>m</a><hr>" * 4
    html = f"<div>{wall(PARTS)}</div><div>{menu}</div><div>{wall(PARTS[:1])}</div><div>{menu}</div><div><ul>{links}</ul></div>"
    assert html_text.main_text(html) == "\n".join(PARTS + PARTS[:1])


@pytest.mark.parametrize("html, text", [
    ("<figure class='overflow-hidden'><table><tr><td>cell</table></figure><div class='md:hidden'><p>shown</div>", "cell\nshown"),
    ("<section id=discussion><h2>Discussion</h2><p>said</section><section id='related-work'><p>others</section>", "Discussion\nsaid\nothers"),
    ("<h2 class=related id=toc>Related</h2><div class='article-header'><h1>Title</h1></div><p class='no-widget'>x", "Related\nTitle\nx"),
    ("<div class='lead hidden'>no</div><div class=related>no</div><section id=comments><h2>Comments</h2>no</section><p hidden>no</p>", ""),
])
def test_hints_inside_an_article(html, text):
    assert html_text.main_text(f"<article><p>{LONG}</p>{html}</article>") == (LONG + "\n" + text).strip()


@pytest.mark.parametrize("name", ["share-buttons", "ad-slot", "newsletter-box", "comments-area", "comment-list", "adSlot top", "post-comments",
                                  "social_share", "related-articles", "cookie-notice", "sticky-ad", "js-x sponsored-content"])
def test_compound_hints_inside_an_article(name):
    for tag in ("article", "main"):
        for what in ("class", "id"):
            html = f"<{tag}><p>{LONG}</p><div {what}='{name}'><p>no</p><ul><li>no</ul></div><p>End.</p></{tag}>"
            assert html_text.main_text(html) == f"{LONG}\nEnd."


@pytest.mark.parametrize("name", ["overflow-hidden", "md:hidden", "related-work", "article-header", "header-content", "no-ads", "with-sidebar", "text-block", "card-header",
                                  "entry-content", "toc-free", "admonition", "modal-logic", "ad:slot", "shared-memory"])
def test_other_compounds_stay(name):
    for tag in ("article", "main"):
        html = f"<{tag}><p>{LONG}</p><div class='{name}'><p>Kept.</p></div><p>End.</p></{tag}>"
        assert html_text.main_text(html) == f"{LONG}\nKept.\nEnd."


@pytest.mark.parametrize("name", ["overflow-hidden", "widget", "page-with-sidebar sidebar"])
def test_hinted_wrapper_of_the_text_stays(name):
    for wrap in ("%s", "<article>%s</article>", "<main><p>Intro.</p>%s</main>"):
        html = wrap % f"<div class='{name}'>{wall(PARTS)}<div class=related>no</div></div>"
        assert html_text.main_text(html) == "\n".join([*(["Intro."] if "Intro" in wrap else []), *PARTS])


def test_article_header_without_an_article():
    html = f"<div class='site-header'><p>{LONG}</p></div><div class='article-header'><h1>Title</h1></div><div class='content-body'>{wall(PARTS)}</div>"
    assert html_text.main_text(html) == "\n".join(["Title", *PARTS])


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE % ("<article><h1>Title</h1>", "</article>"), "x"), (None, None, None, None), (1, "u", "", "x")],
                               "page_id long, url string, html string, text string")
    same(html_text.extract(df).collect(), [(1, "u", "Title\n" + BODY, len("Title\n" + BODY)), (None, None, "", 0), (1, "u", "", 0)])
    assert html_text.extract(df.where("false")).collect() == []
    clash = html_text.extract(df.withColumn("n_chars", html_text.F.lit("mine")))
    assert [r.n_chars for r in clash.collect()] == [len("Title\n" + BODY), 0, 0]


def wanted_tokens(rows):
    library = tokens.load(public_tokenizers.path("word_bpe_49k.json"))
    for key, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False))
        yield key, len((text or "").encode()), n, n > 2048


def test_tokens_hostile(spark, hostile, rows):
    odd = [(-1, "It's we'll DON'T <|endoftext|> x<|startoftext|>"), (-2, "a\x1cb\x85c　d"), (-3, "ΑΣ Σ é é İ ŉ"), (-4, "日本 123 ½ ‘q’"), (-5, "z" * 5000)]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    for df, want in ((hostile, [(r[0], r[1]) for r in rows]), (more, odd)):
        found = tokens.count_tokens(df, public_tokenizers.path("word_bpe_49k.json"), cache_words=3)
        same([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()], wanted_tokens(want))


def test_tokens_real_and_empty(spark, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = tokens.count_tokens(docs, path, sample_rows=20, table_words=50)
    same([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()], wanted_tokens([(r.doc_id, r.text) for r in docs.collect()]))
    assert tokens.count_tokens(empty, path).collect() == []


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 10)
    text = "abc  defghijklmnop q\nr s t uvwxyz " * 9
    assert [w for piece in tokens.pieces(text) for w in piece] == text.split()


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "licensed under the apache license, version 2.0"
    files = [("a/LICENSE", f"{mit}\nmany other words follow here and there, more than the line has"), ("a/x.py", "code"), ("a/b/y.py", None),
             ("a/b/z.py", f"# head\n{apache}\n" + "code " * 500), ("c/d/e", ""), ("c/COPYING", apache), ("c/d/COPYING", mit), (None, "x"),
             (None, mit), ("top", "The license of truth was not the MIT of old"), ("c/d/e", ""), ("/r/f", "x")]
    df = spark.createDataFrame([(p, t, "mine") for p, t in files], "path string, text string, license string")
    got = [(r.path, r.license, r.found, r.folder) for r in licenses.scan_licenses(df).collect()]
    same(got, [("a/LICENSE", "MIT", "file", None), ("a/x.py", "MIT", "inherited", "a"), ("a/b/y.py", "MIT", "inherited", "a"),
               ("a/b/z.py", "Apache-2.0", "header", None), ("c/d/e", "MIT", "inherited", "c/d"), ("c/COPYING", "Apache-2.0", "file", None),
               ("c/d/COPYING", "MIT", "file", None), (None, None, "none", None), (None, "MIT", "file", None), ("top", None, "none", None),
               ("c/d/e", "MIT", "inherited", "c/d"), ("/r/f", None, "none", None)])
    assert licenses.scan_licenses(df.where("false")).collect() == []


def test_licence_lines_are_all_tried(spark):
    """Passing over lines without heavy words changes nothing."""
    matcher = licenses.Matcher(licenses.TEMPLATES, licenses.LEAST)
    every = licenses.Matcher(licenses.TEMPLATES, licenses.LEAST)
    every.heavy = __import__("re").compile("")
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [t.replace(" the", "") + "\n" + t[: len(t) // 2] for _, t in licenses.TEMPLATES]
    assert [matcher.scan(t) for t in texts] == [every.scan(t) for t in texts]
    assert all(matcher.scan(t)[0] == name for name, t in licenses.TEMPLATES)


def test_whole_licence_files(spark):
    """Full texts, also without their ends and with a copyright line, without a name that says so."""
    texts = licenses.full_texts()
    files = [(f"{name}/x", t) for name, t in texts] + [(f"{name}/y", "Copyright (c) 2020 Somebody\n" + " ".join(t[: len(t) * 19 // 20].split())) for name, t in texts]
    got = licenses.scan_licenses(spark.createDataFrame([*files, ("MIT/z", "code")], "path string, text string")).collect()
    same([(r.path, r.license, r.found) for r in got], [*((p, p.split("/")[0], "file") for p, _ in files), ("MIT/z", "MIT", "inherited")])


GNU2 = """/* This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version. */
"""


@pytest.mark.parametrize("text, name", [
    (GNU2, "GPL-2.0"), (GNU2.replace("version 2", "version 3"), "GPL-3.0"), (GNU2.replace("General", "Affero General").replace("version 2", "version 3"), "AGPL-3.0"),
    (GNU2.replace("This program", "This library").replace("General", "Lesser General").replace("version 2", "version 2.1"), "LGPL-2.1"),
    (GNU2.replace("This program", "This library"), "GPL-2.0"),
    ("# Redistribution and use in source and binary forms, with or\n# without modification, are permitted provided that the following\n# conditions are met:", "BSD-3-Clause"),
    ("We wrote it in one long spring. It took time. Released under the MIT License. It is used by many people in the world. " * 4, "MIT"),
    ("// Licensed under the\n// Apache License,\n//\n// Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 2.", "LGPL-2.0"), ("Licensed under CC BY 3.0.", None),
])
def test_wrapped_headers_and_versions(text, name):
    matcher = licenses.Matcher(licenses.TEMPLATES, licenses.LEAST, licenses.full_texts())
    found = matcher.scan("import x\n" + text + "\n" + "code here\n" * 300)
    assert found[0] == name and found[2] < 0.5
