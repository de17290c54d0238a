"""Entities in titles and links are decoded once."""

from webgrain.operators.html import _unescaped
from pyspark.sql import functions as F

CASES = {
    "a &amp; b &#8217;s &#x27;q&#X27; &eacute;": "a & b ’s 'q' &eacute;", "&amp;#39; &amp;lt; &lt;i&gt;": "&#39; &lt; <i>", "&#128512;&#0;&#xD800;&#99999999999;&#1114112;&#00065;": "😀\ufffd\ufffd\ufffd\ufffdA",
    "&# &#; &#x; &#12": "&# &#; &#x; &#12", "": "", "&#38;lt;": "&lt;", "&#65;&#65;": "AA", "&apos;&quot;&nbsp;": "'\" ",
}


def test_entities(spark):
    rows = spark.createDataFrame([(k,) for k in [*CASES, None]], "t string").select("t", _unescaped(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == {**CASES, None: None}
