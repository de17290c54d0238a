"""Queries with one row for each part of a value, and on addresses: chunks of texts, rows of tables, networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from webgrain.functions import parts
from webgrain.operators.html import table_rows
from webgrain.operators.networks import longest_prefix, networks
from webgrain.plans.registry import register, table


@register("chunks_of_documents", """
WITH RECURSIVE d AS (SELECT doc_id, replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)) AS md FROM documents),
c AS (
  SELECT doc_id, md, -1 AS chunk, 0 AS start, 0 AS stop FROM d
  UNION ALL
  SELECT doc_id, md, chunk + 1, stop, stop + CASE WHEN length(w) = 500 AND back > 0 AND 500 - back - 1 > 250 THEN 500 - back - 1 ELSE length(w) END
  FROM (SELECT *, substr(md, stop + 1, 500) AS w, instr(reverse(substr(md, stop + 1, 500)), chr(10) || chr(10)) AS back FROM c) WHERE w <> ''
)
SELECT doc_id, chunk, start, md5(substr(md, start + 1, stop - start)) AS content FROM c WHERE chunk >= 0
""")
def chunks_of_documents(spark, sf_dir):
    """Every chunk of every document."""
    parts.register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n\n")).alias("md"))
    return spark.sql("SELECT doc_id, chunk, start, md5(content) AS content FROM {docs} d, LATERAL text_chunks(d.md, 500)", docs=docs)


@register("table_rows_of_orders", """
SELECT o_orderkey, CAST(0 AS INTEGER) AS table_no, 'order ' || o_orderkey AS name, CAST(0 AS INTEGER) AS row_no, true AS header, 'line|flag|&' AS cells FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL
SELECT l_orderkey, 0, 'order ' || l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS INTEGER), false, l_linenumber || '|' || l_returnflag || '|' FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def table_rows_of_orders(spark, sf_dir):
    """Orders as pages with a table of their lines, and the rows read from the pages; an order has a few lines."""
    row = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("<td><b>"), "l_returnflag", F.lit("</b></tr>"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["row"]), "")
    head = F.concat(F.lit("<body><table><caption> order "), F.col("o_orderkey").cast("string"), F.lit("</caption><thead><tr><th>line<th>flag<th>&amp;</tr></thead><tbody>"))
    pages = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey").select("o_orderkey", F.concat(head, body, F.lit("</tbody></table>")).alias("html"))
    return table_rows(pages, "o_orderkey", "html").withColumn("cells", F.array_join("cells", "|"))


#: Weights that spread keys over 32-bit numbers.
_SPREAD, _SPREAD_NETS = 2_654_435_761, 2_246_822_519


def _spread(n, weight):
    """``n * weight`` modulo 2^32, by halves so that no product leaves 64 bits, however large the key."""
    low, high = n.bitwiseAND(F.lit(0xFFFF)), F.shiftright(n, 16).bitwiseAND(F.lit(0xFFFF))
    return (low * F.lit(weight) + F.shiftleft((high * F.lit(weight)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def _quad(n):
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def _long(n):
    return F.concat(F.lit("2001:DB8:"), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535))))


@register("networks_of_events", f"""
WITH a AS (SELECT event_id, (user_id * 1000003 + event_id % 1000) * {_SPREAD} % 4294967296 AS n, event_id % 2 AS f FROM events),
w AS (SELECT c_custkey AS k, c_custkey * {_SPREAD_NETS} % 4294967296 AS n, 4 + c_custkey % 13 AS bits, c_custkey // 13 % 2 AS f FROM customer)
SELECT event_id, max(bits + 32 * f) AS bits, arg_min(k, (-bits, k)) AS network FROM (SELECT a.event_id, a.f, w.bits, w.k FROM a LEFT JOIN w ON a.f = w.f AND a.n >> (32 - w.bits) = w.n >> (32 - w.bits)) GROUP BY event_id
""")
def networks_of_events(spark, sf_dir):
    """The smallest network of each event's address; addresses of both families, networks from customers."""
    events = table(spark, sf_dir, "events").select("event_id", _spread(_spread(F.col("user_id").cast("long"), 1_000_003) + F.col("event_id") % 1000, _SPREAD).alias("n"))
    seen = events.select("event_id", F.when(F.col("event_id") % 2 == 0, _quad(F.col("n"))).otherwise(F.concat(_long(F.col("n")), F.lit("::1"))).alias("ip"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), _spread(F.col("c_custkey").cast("long"), _SPREAD_NETS).alias("n"))
    bits = F.col("k") % 13 + 4
    six = F.floor(F.col("k") / 13) % 2 == 1
    nets = networks(customers.select(F.when(six, F.concat(_long(F.col("n")), F.lit("::/"), (bits + 32).cast("string"))).otherwise(F.concat(_quad(F.col("n")), F.lit("/"), bits.cast("string"))).alias("network"), F.col("k").alias("value")))
    found = longest_prefix(seen, nets).withColumnsRenamed({"address": "ip", "value": "network"})
    return seen.join(found, "ip").select("event_id", F.col("bits").cast("long").alias("bits"), "network")
