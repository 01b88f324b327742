"""Units of HTML pages hold the whole text of their elements, whatever is nested in them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditframe.functions import documents

PAGES = {
    "<li>first<ul><li>inner</li></ul>tail must always work</li><p>next</p>": ["firstinnertail must always work", "next"],
    "<ul><li>a<ul><li>b<ol><li>c</li></ol>d</li><li>e</li></ul>f</li></ul><LI>g</li>": ["abcdef", "g"],
    "<p>x <code>f(<code>y</code>)</code> z</p><code>q</code>": ["x f(y) z", "q"],
    "<li>one<p>two<br>three</p>four</li>five</li><p>six</p>": ["onetwothreefour", "six"],
    "<ul><li>a<li>b</ul>outside<p>open": ["ab", "open"],
    "<pre>no unit</pre><param>no</param><p/>none<p>yes</p>": ["yes"],
}


@pytest.mark.parametrize("html", PAGES)
def test_whole_elements(spark, html):
    df = spark.createDataFrame([(html,)], "html string").select(F.inline(documents.html_units(F.col("html"))))
    assert [r.text for r in df.orderBy("section_no", "unit_no").collect()] == PAGES[html]
