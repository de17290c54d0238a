"""Table functions that make one row of each part of a value, called with LATERAL once ``register(spark)`` was called.

They are plain table functions with Arrow transfer: Spark doesn't take those of Arrow arrays on the right of LATERAL.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from webgrain.operators.html import rows_of


@udtf(returnType="chunk int, start int, content string", useArrow=False)
class TextChunks:
    """``text_chunks(text, chars)``: consecutive chunks that make up a text, none of null and empty texts.

    A chunk ends after ``chars`` characters, or at the last blank line of them if that
    lies in their back half.
    """

    def eval(self, text: str | None, chars: int | None) -> Iterator[tuple[int, int, str]]:
        text, chars = text or "", max(1, chars or 1)
        at = chunk = 0
        while at < len(text):
            back = text.rfind("\n\n", at, at + chars) - at
            end = at + (back if back > chars // 2 and at + chars <= len(text) else chars)
            yield chunk, at, text[at:end]
            at, chunk = end, chunk + 1


@udtf(returnType="table_no int, name string, row_no int, header boolean, cells array<string>", useArrow=False)
class TableRows:
    """``table_rows(html)``: the rows of each outermost table of a page, the header first where there is one."""

    def eval(self, html: str | None) -> Iterator[tuple[int, str, int, bool, list[str]]]:
        yield from rows_of(html)


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_chunks", TextChunks)
    spark.udtf.register("table_rows", TableRows)
