"""Rendering rules: rows that a caller adds, and the gfm option."""

import pytest

from pagemill.plans.render_rules import SCHEMA

PAGE = ("<main><p>press <kbd>F1</kbd>, <kbd class='big x'>F2</kbd> <b>now</b> <del>old</del></p>"
        "<ul><li><input type=checkbox checked> done</li></ul><table><tr><th>a</th><th>b</th></tr></table></main>")


def body(convert, **opts):
    return convert([(1, "https://h.example/a", PAGE)], **opts).body.collect()[0].body


def test_given_rules(convert):
    assert body(convert, gfm=True) == "press F1, F2 **now** ~~old~~\n\n-   [x] done\n\n| a | b |\n| --- | --- |"


@pytest.mark.parametrize("rows, want", [
    ([("kbd", None, "<", ">", None, False)], "press <F1>, <F2> **now** ~~old~~"),
    ([("kbd", "big", "{", "}", None, False), ("kbd", None, "<", ">", None, False)], "press <F1>, {F2} **now** ~~old~~"),
    ([("b", None, "__", "__", None, False), ("b", None, "++", "++", None, False)], "press F1, F2 ++now++ ~~old~~"),
])
def test_added_rules(spark, convert, rows, want):
    assert body(convert, render_rules=spark.createDataFrame(rows, SCHEMA)).split("\n")[0] == want


def test_without_gfm(convert):
    assert body(convert, gfm=False) == "press F1, F2 **now** old\n\n-   done\n\na\n\nb"


def numbered(given):
    """Labels by the stated rule, looked up one by one."""
    used, out = set(), []
    for raw in given:
        label = raw if raw and raw not in used else next(str(n) for n in range(len(out) + 1, 10 ** 9) if str(n) not in used)
        used.add(label)
        out.append(label)
    return out


@pytest.mark.parametrize("given", [["1"] * 2000, ["3", "", "2", "", "3", "x", "x", "07", "7", "", "", "11", "", "", "12", ""],
                                   [str(n) for n in range(300, 0, -1)] + [""] * 300])
def test_note_labels(spark, given):
    from pagemill.operators.footnotes import labels
    refs = spark.createDataFrame([(1, 1, i, f"t{i}", raw) for i, raw in enumerate(given)],
                                 "page_id long, phase int, ref_pos int, target string, raw_label string")
    assert [r.label for r in labels(refs).orderBy("ord").collect()] == numbered(given)
