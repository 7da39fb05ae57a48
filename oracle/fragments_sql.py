"""DuckDB versions of the fragment page views (same templates)."""

from __future__ import annotations

from pagemill.sources.fragments import RECIPES, _parts

from .sqlfn import q


def fragment_sql(name: str) -> str:
    src, key, ncol, scol, templates = RECIPES[name]
    cols = {"{k}": f"{key}::VARCHAR", "{n}": f"{ncol}::VARCHAR", "{s}": f"{scol}::VARCHAR"}
    whens = []
    for i, tpl in enumerate(templates):
        expr = " || ".join(cols.get(p, q(p)) for p in _parts(tpl))
        whens.append(f"WHEN {i} THEN {expr}")
    html = f"CASE {key} % {len(templates)} " + " ".join(whens) + " END"
    url = f"'https://site' || ({key} % 7)::VARCHAR || '.example.org/d/' || {key}::VARCHAR"
    return f"SELECT {key}::BIGINT AS page_id, {url} AS url, {html} AS html FROM {src}"
