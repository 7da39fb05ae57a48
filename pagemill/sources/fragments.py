"""Fragment page views for operators the crawled ``pages`` table never exercises.

Each view turns rows of a given table (``part``, ``supplier``) into small
HTML pages ``(page_id, url, html)`` by string concatenation of integer and
text columns, so the same pages can be rebuilt in any SQL engine. The HTML
varies with the row key through a fixed list of templates (``{k}`` = key,
``{n}`` = name column, ``{s}`` = size column); every row yields one page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# The templates of each fragment view (source table, key,
# name and size columns, templates chosen by key modulo their count).
RECIPES = {
    "frag_images": ("part", "p_partkey", "p_name", "p_size", [
        '<article><p>Image {k}</p><img data-src="/img/a{k}.jpg" src="/placeholder.gif" alt="A{k}" width="640" height="480"></article>',
        '<article><p>Image {k}</p><img src="/x.gif" data-src="data:x" srcset="a{k}.jpg 320w, b{k}.jpg 1024w" alt=""></article>',
        '<article><p>Image {k}</p><picture><source srcset="p{k}.webp 1x, q{k}.webp 2x"><img src="fallback{k}.jpg"></picture></article>',
        '<article><p>Image {k}</p><img src="pixel{k}.gif" width="1" height="1"></article>',
        '<article><p>Image {k}</p><img src="w{k}.png" width="31" height="32" alt=" {n} "></article>',
        '<article><p>Image {k}</p><img data-lazy-srcset="l{k}.jpg 2x" title="T{k}" alt="Alt {k}"></article>',
    ]),
    "frag_media": ("part", "p_partkey", "p_name", "p_size", [
        '<article><p>Media {k}</p><iframe src="https://www.youtube.com/embed/v{k}" title="Video {k}"></iframe></article>',
        '<article><p>Media {k}</p><video data-src="/media/v{k}.mp4"></video></article>',
        '<article><p>Media {k}</p><video><source data-src="/m/{k}.webm"><source src="/m/{k}.mp4"></video></article>',
        '<article><p>Media {k}</p><audio aria-label="Track {k}"><source src="//cdn.example.net/a/{k}.mp3"></audio></article>',
        '<article><p>Media {k}</p><iframe data-url="https://WWW.Vimeo.com/{k}" data-title="{n}"></iframe></article>',
        '<article><p>Media {k}</p><audio></audio></article>',
    ]),
    "frag_svg": ("part", "p_partkey", "p_name", "p_size", [
        '<article><div><svg width="16" height="16"><title>icon</title></svg></div></article>',
        '<article><div><svg width="200" height="100"><title>Architecture diagram {k}</title></svg></div></article>',
        '<article><div><svg width="500" height="300" aria-label="Flow chart {k}"></svg></div></article>',
        '<article><div><svg width="500" height="300"><desc> {n} </desc></svg></div></article>',
        '<article><div>Caption text {k}<svg width="500" height="300"><g></g></svg></div></article>',
        '<article><div><svg width="47" height="48"></svg></div></article>',
        '<article><p>Icon {k}</p><a href="/i/{k}"><svg width="16" height="16"><title>home</title></svg></a><ul><li><svg width="8" height="8"></svg></li><li>item</li></ul></article>',
    ]),
    "frag_code": ("part", "p_partkey", "p_name", "p_size", [
        '<article><pre data-language="TypeScript"><code>\nconst x{k} = 1;\n\n</code></pre></article>',
        '<article><pre><code class="hl language-python">print({k})</code></pre></article>',
        '<article><pre data-title="main.go" class="lang-go"><code>package main</code></pre></article>',
        '<article><figure data-rehype-pretty-code-figure="" data-language="rust"><figcaption data-rehype-pretty-code-title="">src/{k}.rs</figcaption><pre><code>fn main() {}</code></pre></figure></article>',
        '<article><pre><code>plain {k}</code></pre></article>',
        '<article><pre title="  Demo   {k} "><code data-lang="SQL" title="q">select {s};</code></pre></article>',
        '<article><h2 id="lb{k}"> Label {k} </h2><div data-rehype-pretty-code-figure="" aria-labelledby="lb{k}"><span data-language="TOML">x</span><button>Copy</button><pre><button>C</button><code>a = {s}</code></pre><p>kept {n}</p></div></article>',
        '<article><div data-rehype-pretty-code-figure=""><div class="CodeBlockPanel"><span class="CodeBlockPanelTitle"> file {k}.css </span></div><pre><code>a b</code></pre><pre><code>b</code></pre></div></article>',
        '<article><div data-demo=""><div role="tab" aria-selected="true">Tab {k}</div><div role="figure"><div role="tablist">all</div><pre><code class="lang-Go">x</code></pre><button>Run</button></div></div></article>',
    ]),
    "frag_inline": ("part", "p_partkey", "p_name", "p_size", [
        '<article><p># {n}</p><p>{k}. x<br>- {n}</p><p><span>&gt; q {k}</span> <b># no</b></p><p>-{k} and {s}.{k}</p></article>',
        '<article><p>use <code>a`{k}</code>, <code>``</code> and <code>{n}</code></p><p><del>{n}</del> <s>{k}</s></p></article>',
        '<article><ul><li><input type="checkbox" checked> done {k}</li><li><input type="CHECKBOX">{n}</li><li><p><input type="checkbox"> in a paragraph</p></li></ul><p><input type="text">x</p></article>',
        '<article><pre>\n{n}\n    # {k}  *x*\n\n\n\n- end\n</pre><blockquote><pre>a{k}\n\nb</pre></blockquote></article>',
        '<article><p>say “{n}”</p><ul><li>x<pre><code>q = “{k}”\n\n\n\nend  </code></pre></li></ul><blockquote><pre><code>‘a’\n\nb</code></pre></blockquote><p>‘{k}’</p></article>',
    ]),
    "frag_alternate": ("supplier", "s_suppkey", "s_name", "s_nationkey", [
        '<html><head><title>Doc {k}</title><link rel="alternate" type="text/markdown" href="/md/{k}.md"></head><body><article><h1>Doc {k}</h1><p>{n}</p></article></body></html>',
        '<html><head><title>Doc {k}</title><link rel="alternate" type="text/html" href="/alt/{k}"><link rel="alternate" type="text/markdown" href="md/{k}.md"></head><body><main><h2>Page {k}</h2><p>{n}</p></main></body></html>',
        '<html><head><title>Doc {k}</title></head><body><article><h1>No alternate {k}</h1><p>{n}</p></article></body></html>',
    ]),
    "frag_figures": ("part", "p_partkey", "p_name", "p_size", [
        '<article><p>Figure {k}</p><figure><img src="/f/{k}a.png" alt="First {k}"><img src="/f/{k}b.png" title="Second"><figcaption> {n} </figcaption></figure></article>',
        '<article><p>Figure {k}</p><figure><img data-src="/f/{k}.jpg" alt="Only"></figure></article>',
        '<article><p>Figure {k}</p><figure><figcaption>No image {k}</figcaption><p>Text {n}</p></figure></article>',
        '<article><p>Figure {k}</p><figure><picture><source srcset="/f/{k}.webp 2x"><img src="/f/{k}.png"></picture><figcaption>Pic {k}</figcaption></figure></article>',
    ]),
    "frag_notes": ("part", "p_partkey", "p_name", "p_size", [
        '<article><p>Claim<sup><a href="#fn1">[1]</a></sup> and more<sup><a href="#fn2">[2]</a></sup>.</p><ol><li id="fn1">First note {k} <a href="#fnref1">back</a></li><li id="fn2">Second {n}<a class="footnote-backref" href="#x">back</a></li></ol></article>',
        '<article><p>A<sup><a href="#n{k}">1</a></sup> B<a class="fnref" href="#m{k}">[1]</a> C<sup><a href="#n{k}">1</a></sup></p><div><p id="n{k}">Note n</p><p id="m{k}">Note m {n}</p></div></article>',
        '<article><p>X<a data-footnote-ref="" href="#d{k}">x</a> Y<sup><a href="#missing">[9]</a></sup></p><ul><li id="d{k}">Def {k}</li></ul></article>',
        '<article><p>Z<sup><a href="#z{k}">1</a></sup></p><div id="z{k}"><p>1. See <a href="https://x.org/{k}">the <b>{n}</b></a> and <code>a|`b</code></p><p>more*</p> <a href="#fnref1">back</a><img src="/n{k}.png" alt="pic"></div></article>',
        '<article><p>No notes {k}</p></article>',
    ]),
    "frag_sanitize": ("part", "p_partkey", "p_name", "p_size", [
        '<article onclick="x()"><p onmouseover="y" class="c{k}" aria-label="{n}">A {k}</p><a href=" java\tscript:alert(1)" id="a">l</a><custom-el data-x="1"><b data-y="{k}">{n}</b></custom-el></article>',
        '<article><img src="javascript:x" onerror="e" alt="{n}"><img src="data:image/png;base64,AA" alt="d"><object data="/o{k}"><p>in object</p></object><a href="data:text/html,x" title="t">d</a></article>',
        '<article><form action="vbscript:z"><p style="color:red" title="t{k}" nonce="{s}">{n}</p></form><template><b>t</b></template><a href="https://x.org/{k}" target="_blank">ok</a></article>',
    ]),
    "frag_plain": ("supplier", "s_suppkey", "s_name", "s_nationkey", [
        '<html><body><div class="top"><ul><li><a href="/a/{k}">A long menu entry for visitors</a></li><li><a href="/b">Another entry of the menu {k}</a></li></ul></div><div id="text"><h1>Head {k}</h1><p>First text of {n}, which is long, and has commas.</p><p>Second text of {n}, number {k}, as long as the first.</p></div><div class="end"><p>Short end.</p></div></body></html>',
        '<body><div><div><p>Only {k}, a text that is nested once more, in two boxes of its own.</p></div><p>Beside it, {n} has this second text, somewhat longer, and it has commas, too, so that it counts.</p></div><p>Loose end</p></body>',
        '<div><p>too short {k}</p></div><p>out</p>',
        '<body><table><tr><td>Cell {k} with a text long enough to count, says {n}.</td><td><a href="/x">A linked cell that is as long as it</a></td></tr></table><section><div>bare text that is in no block, {n}, long as it may be</div></section></body>',
        '<body><div><p>A quoted, shared, and divided text of {n}, long, long, long.</p></div><div><p>A quoted, shared, and divided text of {n}, long, long, long.</p></div></body>',
    ]),
    "frag_tables": ("supplier", "s_suppkey", "s_name", "s_nationkey", [
        '<article><table><thead><tr><th>Key</th><th>Name</th></tr></thead><tbody><tr><td>{k}</td><td>{n}</td></tr></tbody></table></article>',
        '<article><table><tr><th>A</th><th>B</th><th>C</th></tr><tr><td>{k}</td><td>{s}</td><td>x|y</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table></article>',
        '<article><table><tr><td>only {k}</td></tr></table></article>',
        '<article><table><tr><td>1<table><tr><td>in {k}</td><td>{n}</td></tr></table>after</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table></article>',
        '<article><table><tr><th>Markup</th><th><em>{n}</em></th></tr><tr><td><a href="/c/{k}" title="t">link <b>{s}</b></a><br><code>x|y</code></td><td><img src="/t{k}.png" alt="pic {k}"> and<p>a_b</p><ul><li>i</li><li>j</li></ul></td></tr></table></article>',
        '<article><table><tr><td>Cell<sup><a href="#c{k}">1</a></sup></td></tr></table><p id="c{k}">Note of a cell</p></article>',
    ]),
    "frag_headings": ("part", "p_partkey", "p_name", "p_size", [
        '<article><h1>{n}</h1><h2>Part {k}</h2><p>a</p><h2>Part {k}</h2><h3>Part {k}</h3><p>b</p></article>',
        '<article><h2 id="own-{k}">Named</h2><p>x</p><h4>own-{k}</h4><p>y</p></article>',
        '<article><h2><a href="/h/{k}">Linked {n}</a></h2><p>t</p><h3><a href="/i">One</a> and <em>more</em></h3></article>',
        '<article><h5>Größe &amp; {s}!</h5><h6>  spaced   out </h6><h6></h6><p>z</p></article>',
        '<article><p>none {k}</p></article>',
        '<article><h1>A</h1><h2>a-1</h2><h2>a</h2><h2>A</h2><p>q</p></article>',
    ]),
    "frag_noise": ("supplier", "s_suppkey", "s_name", "s_nationkey", [
        '<article><p>Keep {k}</p><script>var a = "{n}";</script><style>p {}</style><noscript>no</noscript></article>',
        '<article><header>h</header><p>Keep {k}</p><nav><a href="/n">n</a></nav><aside>a</aside><footer>f</footer></article>',
        '<article><p class="head-line">Keep {k}</p><div class="share">s</div><span aria-label="please share this">l</span><a role="button" data-action="do-share" href="/s">b</a><p>{n}</p></article>',
        '<article><div class="ads">x</div><div class="top ad-slot">x</div><div id="ad-{k}">x</div><p>Keep {k}</p><div class="newsletter">x</div><div class="cookie">x</div><div class="banner">x</div><div class="modal">x</div></article>',
        '<article><div class="my-popup">x</div><div class="overlay-{k}">x</div><p>Keep {k}</p><div class="comments">c</div><div id="comments">c</div><div class="related">r</div><ul class="recommended"><li>r</li></ul></article>',
        '<article><p hidden>h</p><p aria-hidden="true">h</p><p aria-hidden="false">Shown {k}</p><p style="color:red; DISPLAY : none">h</p><p style="visibility:hidden !important">h</p><p style="display:none-such">Kept {n}</p></article>',
        '<article><div><p> </p><span></span></div><p><br></p><p>&nbsp;</p><div><img src="/i{k}.png" alt="in"></div><p>Keep {k}</p></article>',
        '<article><div class="related"><p>Keep not</p><nav>{k}</nav></div><p>Keep {k}</p><nav><div class="ads">x</div>y</nav><template><h2>t</h2></template><object data="/o"><p>old</p></object></article>',
    ]),
    "frag_quotes_lists": ("nation", "n_nationkey", "n_name", "n_regionkey", [
        '<article><blockquote><p>Quote {k}</p><p>{n}</p></blockquote><p>after</p></article>',
        '<article><blockquote><p>a</p><blockquote><p>b {k}</p></blockquote><ul><li>c</li></ul></blockquote></article>',
        '<article><ul><li>one {k}</li><li>two<ul><li>in</li><li>deep<ol><li>x</li><li>y</li></ol></li></ul></li></ul></article>',
        '<article><ol start="{k}"><li>a</li><li><p>b</p><p>c</p></li></ol><p><del>old</del> <em>e</em> <strong>s {n}</strong> <code>c{k}</code></p></article>',
        '<article><ul><li><input type="checkbox" checked> done {k}</li><li><input type="checkbox"> open</li></ul><hr><p>x</p></article>',
    ]),
    "frag_links": ("part", "p_partkey", "p_name", "p_size", [
        '<article><p><a href="/a/{k}?utm_source=x&amp;id={k}&amp;fbclid=1">One</a> <a href="#part">Two</a></p></article>',
        '<article><p><a href="javascript:alert(1)">j</a> <a href="../up/{k}" title="T {s}">Up <b>{n}</b></a><a>none</a></p></article>',
        '<article><p><a href="https://www.example.net/p?q={k}#f">{n}</a> <a href="mailto:a@b.example">m</a> <a href="">e</a></p><nav><a href="/gone">g</a></nav></article>',
    ]),
    "frag_meta": ("part", "p_partkey", "p_name", "p_size", [
        '<head><title> Title  {k} &amp; more </title><meta name="description" content="About {n}"><meta name="author" content="W &quot;{s}&quot;"></head><body><article><p>x {k}</p></article></body>',
        '<head><meta name="author"><meta name="author" content="second"><title></title></head><body><p>{k}</p></body>',
        '<head><meta name="Description" content="case"><meta name="description" content=""></head><body><article><p>{n}</p></article></body>',
        '<body><article><svg width="100" height="100"><title>In {k}</title></svg><p>x</p></article></body>',
    ]),
    "frag_errors": ("supplier", "s_suppkey", "s_name", "s_nationkey", [
        '<article><p>Good {k}</p><div data-a="x,y">{n}</div></article>',
        '<!-- only {k} -->',
        '<article><nav>{n}</nav></article>',
    ]),
}


def _parts(template: str):
    """Split a template into literal and placeholder pieces."""
    return [p for p in re.split(r"(\{[kns]\})", template) if p != ""]


def spark_html(template: str, k: Column, n: Column, s: Column) -> Column:
    cols = {"{k}": k.cast("string"), "{n}": n.cast("string"), "{s}": s.cast("string")}
    return F.concat(*[cols.get(p, F.lit(p)) for p in _parts(template)])


def fragment_pages(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    src, key, ncol, scol, templates = RECIPES[name]
    t = table(spark, sf_dir, src).select(key, ncol, scol)
    k, n, s = F.col(key), F.col(ncol), F.col(scol)
    html = None
    for i, tpl in enumerate(templates):
        cond = (k % len(templates)) == i
        h = spark_html(tpl, k, n, s)
        html = F.when(cond, h) if html is None else html.when(cond, h)
    url = F.concat(F.lit("https://site"), (k % 7).cast("string"), F.lit(".example.org/d/"), k.cast("string"))
    return t.select(k.cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
