"""Queries of the pattern libraries over pages, to which a few lines of script and markup are added."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pattern_tables import CLS, INP, WEIGHTS
from ..operators import findings as f
from ..sources.tables import table
from .libraries import _case, _case_sql, _quoted
from .register import registrar

query, QUERIES, ORACLE_SQL = registrar()

ADDED = [
    "", "\nel.addEventListener('click', () => { box.classList.add('x'); box.style.width = '1px'; el.offsetHeight; })", '<img src="a.png">\n<img src=b.png><iframe src="//ads.example"></iframe>',
    "<button onclick='x()'>\n@font-face { font-family: a }\n.a { transition: height 1s }", "\nfor (let i = 0; i < 10; i++) { p.innerHTML = i; }\nJSON.parse(t); setAttribute('a', 1)" * 4,
]
TEXT = f"SELECT page_id, html || {_case_sql(ADDED, 'page_id')} AS t FROM pages"


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.concat("html", _case(ADDED, "page_id")).alias("t"))


FOUND = " UNION ALL ".join(f"SELECT page_id, '{n}' AS pattern, '{c}' AS category, '{s}' AS severity, len(regexp_extract_all(t, {_quoted('(?im)' + p)})) AS n, len(regexp_extract_all(t, {_quoted('(?im)' + p)})) * {WEIGHTS[s]} AS score FROM x" for n, p, c, _, s in INP)


@query(f"WITH x AS ({TEXT}), f AS ({FOUND}) SELECT * FROM f WHERE n > 0")
def txt_inp_patterns(spark, sf):
    return f.found(_pages(spark, sf), ["page_id"], "t", INP)


@query()
def txt_cls_patterns(spark, sf):
    """Patterns with look-ahead, which the other engine's expressions lack; compared with Python's in the tests."""
    return f.found(_pages(spark, sf), ["page_id"], "t", CLS)


@query(f"""WITH x AS ({TEXT}), f AS ({FOUND}), g AS (SELECT page_id, sum(n) FILTER (severity = 'high') AS high, sum(n) FILTER (category = 'discrete_input') AS d, sum(n) FILTER (category IN ('paint_trigger', 'layout_thrash')) AS p, sum(score) AS total, sum(score) FILTER (severity = 'high') AS hs FROM f WHERE n > 0 GROUP BY 1)
SELECT page_id, CASE WHEN d > 0 AND p > 0 AND high > 10 THEN 'high' WHEN d > 0 AND p > 0 AND high > 3 THEN 'medium' WHEN d > 0 THEN 'low' ELSE 'none' END AS confidence, CASE WHEN hs >= 15 THEN 'high' WHEN hs >= 6 OR total >= 20 THEN 'medium' WHEN total > 0 THEN 'low' ELSE 'none' END AS risk FROM g""")
def txt_risk_levels(spark, sf):
    return f.totals(f.found(_pages(spark, sf), ["page_id"], "t", INP), ["page_id"]).select("page_id", f.inp_confidence().alias("confidence"), f.file_risk().alias("risk"))
