"""What a conversion's plans move: tokens and elements stay where their page is."""

import pytest


@pytest.fixture
def plans(monkeypatch):
    """Plans of all that is written on the way."""
    from pagemill.plans import convert, corpus, materialize

    seen, real = [], materialize.materialize

    def noted(df, how=None):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, how)

    for module in (convert, corpus):
        monkeypatch.setattr(module, "materialize", noted)
    return seen


def test_tokens_are_not_shuffled(spark, plans):
    from pagemill.plans.convert import Conversion
    from pagemill.plans.corpus import Corpus

    conv = Conversion(spark, Corpus.from_dir(spark, "/root/testdata/sf0.001"))
    plans.append(conv.documents._jdf.queryExecution().executedPlan().toString())
    moved = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(plans) > 10 and len(moved) <= 10
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"  # the caller's session is as it was


@pytest.mark.parametrize("query", ["images", "render_fragments", "footnotes"])
def test_pages_are_not_broadcast(spark, plans, query):
    """Fragments of small tables: what belongs to pages is joined where it is, however small its table was."""
    from pagemill.plans.queries import REGISTRY

    plans.append(REGISTRY[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert joins and not [line for line in joins if "page_id" in line or "NestedLoop" in line]


def test_elements_pair_tags_once(spark):
    """Each pairing of tags is in the plan once, whatever is read from it."""
    from pagemill.plans.corpus import Corpus

    plan = Corpus.from_dir(spark, "/root/testdata/sf0.001").elements._jdf.queryExecution().executedPlan().toString()
    assert sum("+- Window [" in line or ":- Window [" in line for line in plan.splitlines()) <= 9


def test_steps_read_their_input_once(spark):
    """Begins and ends of elements, and the conditions of selectors, come from one reading of their input."""
    from pyspark.sql import functions as F

    from pagemill.operators.extract import parent_of
    from pagemill.operators.select import RULE_SCHEMA, conditions, match
    from pagemill.plans.intervals import assign_owner, interval_sums, sweep_keep

    points = spark.createDataFrame([(1, 3, 1)], "page_id long, pos int, w int")
    n = F.col("id").cast("int")
    spans = spark.range(5).select(F.lit(1).cast("long").alias("page_id"), n.alias("open_pos"), (n + 1).alias("end_pos"), (n + 2).alias("stop_pos"))
    facts = spark.range(5).select(F.lit(1).cast("long").alias("page_id"), n.alias("open_pos"), F.lit("tag").alias("key"), n.cast("string").alias("val"))
    conds = conditions(spark.createDataFrame([("*", 1, "b, [title]")], RULE_SCHEMA))
    for df in (sweep_keep(points, spans), interval_sums(points, spans, ["w"]), assign_owner(points, spans), parent_of(spans), match(facts, conds)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_texts_are_collected_by_one_sort(spark):
    """A page session collects texts of sorted groups: a hash of objects would begin again with a sort after 128 of them."""
    from pagemill.plans.corpus import Corpus
    from pagemill.plans.intervals import ordered_concat

    plan = ordered_concat(Corpus.from_dir(spark, "/root/testdata/sf0.001").texts, ["page_id"], "pos", "text")._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" in plan


@pytest.mark.parametrize("query", ["link_fragments", "footnote_appendix"])
def test_broadcasts_have_one_long_as_key(spark, plans, query):
    """Other keys take a memory page of the driver and of each executor for each broadcast, however few its rows are."""
    from pagemill.plans.queries import REGISTRY

    plans.append(REGISTRY[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    sent = [line for plan in plans for line in plan.splitlines() if "BroadcastExchange" in line]
    assert len(sent) >= 4 and all("HashedRelationBroadcastMode(List(xxhash64(" in line and line.count("xxhash64(") == 1 for line in sent)


def test_same_compares_values(spark):
    from pyspark.sql import functions as F

    from pagemill.functions.keys import same

    left = spark.createDataFrame([("a", "b"), ("a", None), ("ab", "")], "x string, y string")
    right = spark.createDataFrame([("a", "b"), ("a", None), ("a", "c")], "u string, v string")
    for hinted in (F.broadcast(right), right):
        rows = left.join(hinted, same((left["x"], right["u"]), (left["y"], right["v"])), "left").collect()
        assert sorted(map(tuple, rows), key=str) == [("a", "b", "a", "b"), ("a", None, None, None), ("ab", "", None, None)]


@pytest.mark.parametrize("query", ["media", "footnotes"])
def test_joins_ask_for_no_filters(spark, plans, monkeypatch, query):
    """A filter of a join's keys would take another pass over pages and go through one task and the driver."""
    from pagemill.plans import corpus
    from pagemill.plans.queries import REGISTRY

    real = corpus.page_session

    def eager(s):  # as if every table were large enough
        session = real(s)
        session.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
        return session

    monkeypatch.setattr(corpus, "page_session", eager)
    plans.append(REGISTRY[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not [plan for plan in plans if "might_contain" in plan or "bloom_filter" in plan]


@pytest.mark.parametrize("html, scored", [("<main><p>text</p></main>", 0), ("<div><p>text, of a page that names no main element</p></div>", 1)])
def test_scores_are_for_pages_without_a_main_element(convert, monkeypatch, html, scored):
    from pagemill.plans import convert as module

    asked, real = [], module.best_container
    monkeypatch.setattr(module, "best_container", lambda *a: asked.append(a) or real(*a))
    conv = convert([(1, "https://a.example/", "<main><p>named</p></main>"), (2, "https://a.example/b", html)])
    assert [r.page_id for r in conv.root.orderBy("page_id").collect()] == [1, 2] and len(asked) == scored


def test_tokens_are_written_once_a_step(convert, monkeypatch):
    """The whole pages' tokens, those that selectors leave and those that cleaning leaves."""
    from pagemill.plans import convert as module
    from pagemill.plans import corpus

    written, real = [], module.materialize

    def noted(df, how=None):
        written.append({"pos", "kind", "text"} <= set(df.columns))
        return real(df, how)

    for m in (module, corpus):
        monkeypatch.setattr(m, "materialize", noted)
    conv = convert([(1, "https://a.example/", "<main><nav>n</nav><p>text</p><p> </p></main>")])
    assert [r.tag for r in conv.cleaned_tokens.filter("kind = 'open'").collect()] == ["p"] and sum(written) == 3


def test_steps_that_others_read_are_written_once(convert, plans, monkeypatch):
    """Notes, images, widgets of code and cells are found once, whatever reads them, and replacements stay with their page."""
    from collections import Counter

    from pagemill.operators import extract

    asked = Counter()
    for name in ("images", "code_widgets"):
        monkeypatch.setattr(extract, name, lambda *a, name=name, real=getattr(extract, name): asked.update([name]) or real(*a))
    html = ('<article><p>Text<sup><a href="#n1">1</a></sup> <img src="/a.png" alt="a"></p><pre><code>x</code></pre><table><tr><th>A</th></tr>'
            '<tr><td>b<sup><a href="#n2">2</a></sup></td></tr></table><ol><li id="n1">One <b>note</b></li><li id="n2">Two</li></ol></article>')
    body = convert([(1, "https://a.example/", html)]).body
    plans.append(body._jdf.queryExecution().executedPlan().toString())
    assert asked == {"images": 1, "code_widgets": 1}
    assert sum(plan.count("Window [") for plan in plans) <= 90 and sum(plan.count("Exchange hashpartitioning") for plan in plans) <= 2
    assert body.first().body == ("Text[^1] ![a](https://a.example/a.png)\n\n```\nx\n```\n\n| A |\n| --- |\n| b[^2] |\n\n"
                                 "[^1]: One **note**\n[^2]: Two")


def test_code_is_looked_for_on_pages_that_hold_some(convert):
    """What is read many times for code holds no other pages."""
    from pagemill.operators.extract import code_blocks

    conv = convert([(1, "https://a.example/", "<main><p>a</p><pre><code>x</code></pre></main>"), (2, "https://a.example/b", "<main><p>b</p></main>")])
    assert [{r.page_id for r in df.collect()} for df in conv.code_pages] == [{1}, {1}]
    assert [(r.page_id, r.code) for r in code_blocks(conv).collect()] == [(1, "x")]
