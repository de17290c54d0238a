"""Feeds as XML: references, CDATA, namespaces, links, and what isn't well-formed."""

from webgrain.sources import web

RSS = """<?xml version="1.0"?><rss xmlns:dc="http://d" xmlns:content="http://c"><channel><title>no item</title>
<item><title>A &amp; B &#8217;s &#x27;x&#x27; &lt;b&gt;</title><link>http://a/?x=1&amp;y=2</link><description>&lt;p&gt;hi&lt;/p&gt;</description><dc:date>2024</dc:date></item>
<item><title><![CDATA[1 < 2 & &amp; 3]]></title><link>
 http://a/2 </link><pubDate>Mon</pubDate><content:encoded>whole</content:encoded></item>
<item><title>broken <b> &amp; open</title><link>http://a/3?p=1&amp;q=2</link></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">T &quot;q&quot;</title><link rel="self" href="http://s/"/><link rel="alternate" href="http://b/?a=1&amp;b=2"/><updated>2025</updated><summary>S</summary></entry>
<atom:entry xmlns:atom="http://www.w3.org/2005/Atom"><atom:title>N</atom:title><atom:link href="http://n/"/></atom:entry></feed>"""


def test_feeds(spark):
    feeds = spark.createDataFrame([("r", RSS), ("a", ATOM), ("n", None), ("t", "no feed")], "url string, body string")
    got = {(r["url"], r["pos"]): (r["title"], r["link"], r["date"], r["description"], r["total"]) for r in web.feed_items(feeds).collect()}
    assert got == {
        ("r", 0): ("A & B ’s 'x' <b>", "http://a/?x=1&y=2", "2024", "<p>hi</p>", 3),
        ("r", 1): ("1 < 2 & &amp; 3", "http://a/2", "Mon", None, 3),
        ("r", 2): ("broken <b> & open", "http://a/3?p=1&q=2", None, None, 3),
        ("a", 0): ('T "q"', "http://b/?a=1&b=2", "2025", "S", 2),
        ("a", 1): ("N", "http://n/", None, None, 2),
    }
    assert web.feed_items(feeds, most=1).count() == 2
