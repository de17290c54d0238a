"""Queries on journal articles in JATS."""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import functions as F

from webgrain.plans.made import made, rows_sql, typed
from webgrain.plans.registry import golden, register, table
from webgrain.sources import articles

ARTICLE = """<?xml version="1.0"?><!DOCTYPE article PUBLIC "-//X//EN" "x.dtd" [<!ENTITY a "b">]>
<article xmlns:xlink="l"><front><article-meta><title-group><article-title>On <italic>Spark</italic> joins</article-title></title-group><abstract><p>Short<xref ref-type="bibr" rid="b2 none"/>.</p></abstract></article-meta></front>
<body><p>Lead costs $5.</p><sec><title>Methods</title><p>Take x<sup>2</sup> and <inline-formula><math><mfrac><mi>α</mi><mn>2</mn></mfrac></math></inline-formula>. <disp-formula><label>(1)</label><math><msup><mi>e</mi><mrow><mi>i</mi><mi>π</mi></mrow></msup><mo>≤</mo><mi>x</mi></math></disp-formula> Then stop.</p>
<sec><title>Data</title><fig><label>Fig. 1</label><caption><p>Figure 1. A [plot]</p></caption><graphic xlink:href="f.png"/></fig><sec><p>deep</p><list><list-item><p>one</p></list-item><list-item><p>two</p></list-item></list></sec></sec></sec>
<table-wrap><label>Table 1</label><caption><p>Sizes</p></caption><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table></table-wrap></body>
<back><ack><p>Thanks.</p></ack><ref-list><ref id="b1"><mixed-citation>First, A.</mixed-citation></ref><ref id="b2">Second</ref></ref-list></back></article>"""
TEXT = r"""# On *Spark* joins

## Abstract

Short [`ref02`].

Lead costs \$5.

## Methods

Take x$^{2}$ and $\frac{\alpha}{2}$.

$$e^{i\pi}\leq x \tag{1}$$

Then stop.

### Data

![Fig. 1: A plot](f.png)

**Section.**

deep

- one

- two

**Table 1.** Sizes

| a | b / c |
|---|---|
| 1 |  |

## Acknowledgements

Thanks.

## References

- [`ref01`] First, A.

- [`ref02`] Second"""


@golden("article_markdown", typed(rows_sql("id, title, markdown, formulas, figures, tables, error", (1, "On *Spark* joins", TEXT, 2, 1, 1, None), (2, None, None, None, None, None, "not an article"), (3, None, None, None, None, None, "not readable: ParseError"), (4, None, None, None, None, None, "not readable: ParseError")), id="BIGINT", formulas="INTEGER", figures="INTEGER", tables="INTEGER"))
def article_markdown(spark, sf_dir):
    rows = made(spark, "id long, xml string", (1, ARTICLE), (2, "<html/>"), (3, "<article>"), (4, None))
    out = articles.article_markdown(articles.article_blocks(rows, "id", "xml"), "id")
    none = F.col("error").isNotNull()
    return out.select("id", "title", "markdown", *(F.when(~none, F.col(c)).alias(c) for c in ("formulas", "figures", "tables")), "error")


FORMULAS = (
    ("<math><msubsup><mi>x</mi><mi>i</mi><mn>2</mn></msubsup></math>", "x_{i}^{2}"),
    ("<math><mi>λ</mi><mi>a</mi><mo>×</mo><mi>Γ</mi></math>", r"\lambda a\times\Gamma"),
    ("<math><msqrt><mi>a</mi><mo>+</mo><mn>1</mn></msqrt></math>", r"\sqrt{a+1}"),
    ("<math><mroot><mi>x</mi><mn>3</mn></mroot></math>", r"\sqrt[3]{x}"),
    ("<math><munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover><mtext>if so</mtext></math>", r"\sum_{i}^{n}\text{if so}"),
    ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr></mtable></math>", r"\begin{matrix}1 & 2\end{matrix}"),
    ("<math><mfenced><mi>a</mi><mi>b</mi></mfenced><mo>%</mo></math>", r"(a, b)\%"),
    ("<math><mfrac><mn>1</mn></mfrac></math>", "1"),
)


@golden("formulas_as_tex", rows_sql("tex", *((t,) for _, t in FORMULAS)))
def formulas_as_tex(spark, sf_dir):
    @F.udf("string")
    def tex(xml):
        return articles.tex(ElementTree.fromstring(xml))

    return made(spark, "xml string", *((x,) for x, _ in FORMULAS)).select(tex("xml").alias("tex"))


@register("article_of_documents", "SELECT doc_id, concat('# T', doc_id) AS head, CAST(1 + len(list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '')) AS INTEGER) AS blocks FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9 \\n]', '', 'g') AS t FROM documents)".replace("\\\\", "\\"))
def article_of_documents(spark, sf_dir):
    """Every document as an article, a paragraph a line."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9 \n]", ""), "\n")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    title = F.concat(F.lit("T"), F.col("doc_id").cast("string"))
    xml = F.concat(F.lit("<article><front><article-meta><title-group><article-title>"), title, F.lit("</article-title></title-group></article-meta></front><body>"), body, F.lit("</body></article>"))
    rows = articles.article_blocks(table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")), "doc_id", "xml")
    md = articles.article_markdown(rows, "doc_id")
    return md.select("doc_id", F.substring_index("markdown", "\n", 1).alias("head"), (F.col("blocks") - 1).alias("blocks"))
