"""Web pages: links and metadata by expressions; main content, Markdown and tables by a small parser in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.batches import by_pieces, kind
from webgrain.functions.urls import classify_link, domain_of, joined_url, part

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
#: Tags that a following tag closes.
CLOSES = {"p": BLOCKS, "li": frozenset({"li"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"}), "thead": frozenset({"tbody", "tfoot"}), "tbody": frozenset({"tbody", "tfoot"})}

#: Pages of text and bare tags only, none of which changes how what follows is read; their pieces are told by one expression.
PLAIN = re.compile(r"(?:[^<]++|</?(?!(?i:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext)>)[a-zA-Z][a-zA-Z0-9]*+>)*+")
PIECES = re.compile(r"<([a-zA-Z0-9]+)>|</([a-zA-Z0-9]+)>|([^<]+)")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def text(self) -> str:
        if len(self.kids) == 1 and isinstance(self.kids[0], str) and self.tag not in ("script", "style"):
            return self.kids[0]
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in ("script", "style"):
                stack.extend(reversed(node.kids))
        return "".join(out)


class Tree(HTMLParser):
    """A forgiving tree: unclosed tags end with their parent."""

    def __init__(self, html: str):
        self.root = Node("document", {})
        self.open = [self.root]
        if PLAIN.fullmatch(html):
            self.read_plain(html)
            return
        super().__init__(convert_charrefs=True)
        self.feed(html)
        self.close()

    def read_plain(self, html: str) -> None:
        """What the parser makes of a page of text and bare tags."""
        for start, end, text in PIECES.findall(html):
            if text:
                self.open[-1].kids.append(unescape(text) if "&" in text else text)
            elif start:
                self.handle_starttag(start.lower(), ())
            else:
                self.handle_endtag(end.lower())

    def handle_starttag(self, tag, attrs):
        opened = self.open
        while len(opened) > 1 and tag in CLOSES.get(opened[-1].tag, ()):
            opened.pop()
        node = Node(tag, {k: v or "" for k, v in attrs} if attrs else {})
        opened[-1].kids.append(node)
        # Deeper nesting than this is flattened, so hostile pages cost no more than their length.
        if tag not in VOID and len(opened) < 200:
            opened.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def hidden(node: Node) -> bool:
    """Whether a reader would not see the node."""
    a = node.attrs
    style = re.sub(r"\s", "", a.get("style", "").lower())
    return node.tag in ("noscript", "template") or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or bool(re.search(r"(left|top|text-indent):-9{3,}", style))


def main_content(root: Node) -> tuple[Node, str]:
    """The node with a page's content, and the rule that found it."""
    rules = (
        ("article", lambda n: n.tag == "article"),
        ("main", lambda n: n.tag == "main"),
        ("[role=main]", lambda n: n.attrs.get("role") == "main"),
        (".content", lambda n: "content" in n.attrs.get("class", "").split()),
        ("#content", lambda n: n.attrs.get("id") == "content"),
        ("body", lambda n: n.tag == "body"),
    )
    for label, rule in rules:
        for node in root.walk():
            if rule(node):
                return node, label
    return root, "document"


def strip_hidden(node: Node) -> int:
    """Remove hidden nodes below a node; how many were removed."""
    removed = 0
    for n in node.walk():
        kept = [k for k in n.kids if not (isinstance(k, Node) and hidden(k))]
        removed += len(n.kids) - len(kept)
        n.kids = kept
    return removed


def grid(table: Node, most: int | None = 500, cell: int | None = 1000) -> tuple[list[str], list[list[str]], str | None]:
    """Headers, rows and caption of a table; cells covered by spans are empty, rows are padded, ``most`` rows at most with the header, ``cell`` bytes of a cell; None is all."""
    rows: list[Node] = []
    caption = None
    for k in table.kids:
        if isinstance(k, Node):
            if k.tag == "caption":
                caption = " ".join(k.text().split()) or None
            rows += [k] if k.tag == "tr" else [r for r in k.kids if isinstance(r, Node) and r.tag == "tr"] if k.tag in ("thead", "tbody", "tfoot") else []
    out: list[list[str]] = []
    covered: dict[tuple[int, int], bool] = {}

    def span(value: str) -> int:
        return min(int(value), 1000) if value.isdigit() and int(value) > 0 else 1

    header = False
    rows = rows[:most]
    for y, row in enumerate(rows):
        cells: list[str] = []
        for c in (k for k in row.kids if isinstance(k, Node) and k.tag in ("td", "th")):
            while covered and (y, len(cells)) in covered:
                cells.append("")
            header = header or (y == 0 and c.tag == "th")
            wide, high = (span(c.attrs.get("colspan", "1")), span(c.attrs.get("rowspan", "1"))) if c.attrs else (1, 1)
            for dy in range(1, min(high, len(rows))):
                for dx in range(wide):
                    covered[y + dy, len(cells) + dx] = True
            value = " ".join(c.text().split())
            # A character has four bytes at most.
            if cell is not None and 4 * len(value) > cell:
                value = value.encode()[:cell].decode("utf-8", "ignore")
            cells += [value, *[""] * (wide - 1)]
        while covered and (y, len(cells)) in covered:
            cells.append("")
        out.append(cells)
    width = max(map(len, out), default=0)
    out = [r + [""] * (width - len(r)) for r in out]
    return (out[0], out[1:], caption) if header else ([], out, caption)


def markdown(node: Node) -> str:
    """Headings, paragraphs, lists, links, images, emphasis, code and tables as Markdown."""
    out: list[str] = []

    def inline(n) -> str:
        if isinstance(n, str):
            return re.sub(r"\s+", " ", n)
        if n.tag in ("script", "style"):
            return ""
        inner = "".join(inline(k) for k in n.kids)
        if n.tag == "br":
            return "\n"
        if n.tag == "a" and n.attrs.get("href"):
            return f"[{inner.strip()}]({n.attrs['href']})"
        if n.tag == "img":
            return f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')})"
        mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}.get(n.tag, "")
        return f"{mark}{inner.strip()}{mark}" if mark and inner.strip() else inner

    def block(n: Node, depth: int) -> None:
        run: list[str] = []

        def flush() -> None:
            t = re.sub(r" *\n *", "\n", "".join(run)).strip()
            run.clear()
            if t:
                out.append(t)

        for k in n.kids:
            if isinstance(k, str) or (k.tag not in BLOCKS and not any(isinstance(x, Node) and x.tag in BLOCKS for x in k.kids)):
                run.append(inline(k))
                continue
            flush()
            if re.fullmatch("h[1-6]", k.tag):
                out.append("#" * int(k.tag[1]) + " " + inline(k).strip())
            elif k.tag == "pre":
                out.append("```\n" + k.text().strip("\n") + "\n```")
            elif k.tag == "hr":
                out.append("---")
            elif k.tag in ("ul", "ol"):
                items = [x for x in k.kids if isinstance(x, Node) and x.tag == "li"]
                out.append("\n".join("  " * depth + (f"{i}. " if k.tag == "ol" else "- ") + " ".join(inline(x).split()) for i, x in enumerate(items, 1)))
            elif k.tag == "table":
                head, rows, _ = grid(k, None, None)
                head = head or [""] * max(map(len, rows), default=0)
                if head:
                    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
                    out.append("\n".join([line(head), "|" + " --- |" * len(head), *map(line, rows)]))
            else:
                block(k, depth)
        flush()

    block(node, 0)
    return "\n\n".join(x for x in out if x.strip())


def inspect(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, markdown, label, removed``: the main content without hidden parts, how it was found, and how many parts went. Null pages give empty text."""

    def read(batch):
        import pyarrow as pa

        out: list[tuple] = []
        for page in batch.column(1).to_pylist():
            node, label = main_content(Tree(page or "").root)
            removed = strip_hidden(node)
            out.append((markdown(node), label, removed))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int32())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "markdown", "label", "removed"])

    return by_pieces(df.select(key, F.col(html).alias("_page")), f"`{key}` {kind(df, key)}, markdown string, label string, removed int", read)


def found_tables(page: str | None) -> list[dict]:
    """Name, headers and rows of each outermost table with rows."""
    found, stack = [], [Tree(page or "").root]
    while stack:
        n = stack.pop()
        if n.tag == "table":
            head, rows, caption = grid(n)
            if head or rows:
                found.append({"name": caption or f"table-{len(found) + 1}", "headers": head, "rows": rows})
        else:
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    return found


def rows_of(page: str | None) -> Iterator[tuple[int, str, int, bool, list[str]]]:
    """Table number, name, row number, whether it is the header, and cells of each row of the outermost tables of a page."""
    for k, t in enumerate(found_tables(page)):
        headed = bool(t["headers"])
        for i, cells in enumerate([t["headers"], *t["rows"]] if headed else t["rows"]):
            yield k, t["name"], i, headed and i == 0, cells


def table_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, table_no, name, row_no, header, cells``: the rows of each outermost table of a page, the header first where there is one."""

    def read(batch):
        import pyarrow as pa

        found = [list(rows_of(page)) for page in batch.column(1).to_pylist()]
        rows = [row for page in found for row in page]
        table_no, name, row_no, header, cells = zip(*rows, strict=True) if rows else ((),) * 5
        whose = batch.column(0).take(pa.array([i for i, page in enumerate(found) for _ in page], pa.int64()))
        columns = [pa.array(c, t) for c, t in zip((table_no, name, row_no, header, cells), (pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string())), strict=True)]
        return pa.RecordBatch.from_arrays([whose, *columns], names=[key, "table_no", "name", "row_no", "header", "cells"])

    return by_pieces(df.select(key, F.col(html).alias("_page")), f"`{key}` {kind(df, key)}, table_no int, name string, row_no int, header boolean, cells array<string>", read)


def tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, table_no, name, headers, rows`` of each outermost table with rows; names are captions or ``table-N`` by place among these."""

    @F.pandas_udf("array<struct<name:string,headers:array<string>,rows:array<array<string>>>>")
    def read(pages: pd.Series) -> pd.Series:
        return pd.Series([found_tables(page) for page in pages])

    return df.select(key, F.posexplode(read(html)).alias("table_no", "t")).select(key, "table_no", "t.*")


def _unescaped(c: Column) -> Column:
    """Text with its frequent entities and all numbered ones decoded; numbers that are no character become the replacement character."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(entity), F.lit(char))

    def put(text: Column, number: Column) -> Column:
        digits = F.regexp_replace(number, "^[xX]?0*", "")
        code = F.when(F.length(digits) <= 7, F.when(number.rlike("^[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int"))
        char = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.replace(text, F.concat(F.lit("&#"), number, F.lit(";")), char)

    numbers = F.array_distinct(F.regexp_extract_all(c, F.lit("&#([xX][0-9a-fA-F]+|[0-9]+);"), 1))
    return F.replace(F.when(c.contains("&#"), F.aggregate(numbers, c, put)).otherwise(c), F.lit("&amp;"), F.lit("&"))


def links(df: DataFrame, key: str, url: str, html: str, most: int = 500) -> DataFrame:
    """``key, pos, href, label``: links of each page, made absolute, each once, at most ``most``; all in the JVM.

    Fragments, scripts, mail and phone links are left out. Relative paths are joined
    with the page's folder; the rare ones with dot segments go through Python's resolver.
    """
    tag = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?[^\"'\s>]+[^>]*>.*?</a>"
    found = df.select(key, F.col(url).alias("_url"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(tag), F.lit(0))).alias("p", "a"))
    href = _unescaped(F.regexp_extract("a", r"(?is)href\s*=\s*[\"']?([^\"'\s>]+)", 1))
    label = F.trim(F.regexp_replace(_unescaped(F.regexp_replace(F.regexp_extract("a", r"(?is)^<a[^>]*>(.*)</a>$", 1), r"<[^>]*>", "")), r"\s+", " "))
    rows = found.select(key, "p", "_url", href.alias("h"), label.alias("label")).where(~F.lower("h").rlike(r"^(#|javascript:|mailto:|tel:)"))
    origin = F.concat(part(F.col("_url"), 1), F.lit("://"), domain_of(F.col("_url")))
    folder = F.regexp_extract(F.regexp_replace("_url", "[?#].*$", ""), r"^([A-Za-z]+://[^/]*(?:/.*)?/)", 1)
    folder = F.when(F.length(folder) > F.length(part(F.col("_url"), 1)) + 3, folder).otherwise(F.concat(origin, F.lit("/")))
    full = F.when(F.col("h").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("h")).when(F.col("h").startswith("//"), F.concat(part(F.col("_url"), 1), F.lit(":"), F.col("h"))).when(F.col("h").startswith("/"), F.concat(origin, F.col("h"))).otherwise(F.concat(folder, F.col("h")))
    dotted = ~F.col("h").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & F.col("h").rlike(r"(^|/)\.\.?(/|[?#]|$)")
    full = F.when(dotted, joined_url(F.when(dotted, F.col("h")), F.col("_url"))).otherwise(full)
    each = rows.select(key, "p", full.alias("href"), "label").where(F.lower("href").rlike("^https?://"))
    first = each.groupBy(key, "href").agg(F.min_by("label", "p").alias("label"), F.min("p").alias("p"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("p")) - 1
    return first.select(key, place.alias("pos"), "href", "label").where(F.col("pos") < most)


def follow_ups(found: DataFrame, key: str, most: int = 20) -> DataFrame:
    """Candidates for reading on: ``key, title, url, type`` of the first links of each page."""
    title = F.when(F.coalesce(F.col("label"), F.lit("")) == "", "(untitled)").otherwise(F.col("label"))
    return found.where(F.col("pos") < most).select(key, title.alias("title"), F.col("href").alias("url"), classify_link(F.col("href")).alias("type"))


def metadata(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """What a page's head says of it, by expressions: title, description, language, charset, canonical address, and maps of
    OpenGraph, Twitter, Dublin Core and link relations, and JSON-LD blocks. Missing values are null, missing maps empty."""
    h = F.coalesce(F.col(html), F.lit(""))
    tags = F.regexp_extract_all(h, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    rels = F.regexp_extract_all(h, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))
    attr = lambda t, name: _unescaped(F.coalesce(F.nullif(F.regexp_extract(t, rf"(?is)\s{name}\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.nullif(F.regexp_extract(t, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1), F.lit("")), F.regexp_extract(t, rf"(?is)\s{name}\s*=\s*([^\s\"'>]+)", 1)))
    pairs = F.transform(tags, lambda t: F.struct(F.lower(F.concat(attr(t, "property"), attr(t, "name"))).alias("k"), attr(t, "content").alias("v")))

    def section(prefix: str) -> Column:
        own = F.filter(F.col("_pairs"), lambda p: p["k"].startswith(prefix) & (p["v"] != ""))
        keys = F.array_distinct(F.transform(own, lambda p: F.substr(p["k"], F.lit(len(prefix) + 1))))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(own, lambda p: p["k"] == F.concat(F.lit(prefix), k)), 1)["v"]))

    named = lambda name: F.get(F.filter(F.col("_pairs"), lambda p: p["k"] == name), 0)["v"]
    links_ = F.transform(rels, lambda t: F.struct(F.lower(attr(t, "rel")).alias("rel"), attr(t, "href").alias("href")))
    rel_names = F.array_distinct(F.filter(F.transform("_links", lambda x: x["rel"]), lambda r: r != ""))
    rel_map = F.map_from_arrays(rel_names, F.transform(rel_names, lambda r: F.transform(F.filter("_links", lambda x: x["rel"] == r), lambda x: x["href"])))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    title = F.regexp_replace(_unescaped(F.regexp_extract("_h", r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " ")
    rows = df.select(key, F.col(url).alias("_url"), h.alias("_h"), pairs.alias("_pairs"), links_.alias("_links"))
    return rows.select(
        key,
        F.when(F.trim(title) != "", title).alias("title"),
        filled(named("description")).alias("description"),
        filled(attr(F.regexp_extract("_h", r"(?is)<html[^>]*>", 0), "lang")).alias("lang"),
        filled(F.regexp_extract("_h", r"(?is)<meta[^>]*charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)).alias("charset"),
        F.coalesce(filled(F.get(F.filter("_links", lambda x: x["rel"] == "canonical"), 0)["href"]), F.col("_url")).alias("canonical"),
        section("og:").alias("opengraph"),
        section("twitter:").alias("twitter"),
        section("dc.").alias("dublin_core"),
        rel_map.alias("rel_links"),
        F.slice(F.filter(F.transform(F.regexp_extract_all("_h", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)), lambda t: F.trim(t)), lambda j: F.try_parse_json(j).isNotNull()), 1, 2).alias("jsonld"),
    )


def feed_links(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, pos, href, type`` of the feeds that a page's head offers."""
    found = df.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))).alias("pos", "t"))
    attr = lambda name: F.regexp_extract("t", rf"(?is)\s{name}\s*=\s*[\"']?([^\"'>]*)", 1)
    kind = F.lower(attr("type"))
    fine = F.lower(attr("rel")).rlike(r"(^|\s)alternate(\s|$)") & kind.rlike(r"^application/(rss|atom|rdf)\+xml|^application/feed\+json|^text/xml") & (attr("hreflang") == "")
    return found.where(fine).select(key, "pos", attr("href").alias("href"), kind.alias("type"))


def embeds(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, manifest, oembed``: the address of a page's manifest, and its embedding services as ``href, format, title``; by expressions."""
    rels = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))
    attr = lambda t, name: _unescaped(F.regexp_extract(t, rf"(?is)\s{name}\s*=\s*[\"']?([^\"'>]*)", 1))
    kind = lambda t: F.regexp_extract(F.lower(attr(t, "type")), r"^(?:application|text)/(json|xml)\+oembed", 1)
    services = F.transform(F.filter(rels, lambda t: (kind(t) != "") & (attr(t, "href") != "")), lambda t: F.struct(attr(t, "href").alias("href"), kind(t).alias("format"), F.nullif(attr(t, "title"), F.lit("")).alias("title")))
    manifest = F.get(F.filter(rels, lambda t: F.lower(attr(t, "rel")) == "manifest"), F.lit(0))
    return df.select(key, F.nullif(attr(manifest, "href"), F.lit("")).alias("manifest"), services.alias("oembed"))


def _value(node: Node) -> str:
    """What an element says as a property: its machine-readable attribute, or its text."""
    for name in ("content", "href", "src", "datetime", "value"):
        if node.attrs.get(name):
            return node.attrs[name]
    return " ".join(node.text().split())


def _items(node: Node, kind: Callable[[Node], list[str]], named: Callable[[Node], list[str]], kinds: str) -> list[dict]:
    """Items of a page, outermost first: ``kind`` names an item's types, ``named`` the properties that an element is of the item around it."""
    out: list[dict] = []
    stack: list[tuple[Node, dict | None]] = [(node, None)]
    while stack:
        at, item = stack.pop()
        names, types = named(at), kind(at)
        own = {kinds: types, "properties": {}} if types else None
        for name in names if item is not None else ():
            item["properties"].setdefault(name, []).append(own if own else _value(at))
        if own and not (names and item is not None):
            out.append(own)
        stack += [(k, own or item) for k in reversed(at.kids) if isinstance(k, Node)]
    return out


def _microformats(node: Node, starts: tuple[str, ...]) -> list[str]:
    return [c.partition("-")[2] if len(starts) > 1 else c for c in node.attrs.get("class", "").split() if c.startswith(starts)]


def structured(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, microdata, microformats, rdfa``: items with their types and properties as JSON; null where a page has none."""

    @F.pandas_udf("struct<microdata:string,microformats:string,rdfa:string>")
    def read(pages: pd.Series) -> pd.DataFrame:
        out = []
        for page in pages:
            found: list = [[], [], []]
            if page and re.search(r"(?i)itemscope|typeof|class\s*=\s*[\"']?[^\"'>]*\bh-", page):
                root = Tree(page).root
                found = [
                    _items(root, lambda n: (n.attrs.get("itemtype") or "").split() or [""] * ("itemscope" in n.attrs), lambda n: n.attrs.get("itemprop", "").split(), "type"),
                    _items(root, lambda n: _microformats(n, ("h-",)), lambda n: _microformats(n, ("p-", "u-", "dt-", "e-")), "type"),
                    _items(root, lambda n: n.attrs.get("typeof", "").split(), lambda n: n.attrs.get("property", "").split(), "type"),
                ]
            out.append([json.dumps(f, ensure_ascii=False, separators=(",", ":")) if f else None for f in found])
        return pd.DataFrame(out, columns=["microdata", "microformats", "rdfa"])

    return df.select(key, read(html).alias("r")).select(key, "r.*")
