"""URL expressions: normal form, canonical identity, links, robots, and addresses that must not be fetched."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webgrain.functions import fixed

#: scheme, authority, path, query of an absolute URL without its fragment.
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trimmed(raw: Column) -> Column:
    """Without white space, quotes and angle brackets around."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"""^["']+|["']+$""", ""), r"^[<>]+|[<>]+$", ""))


def joined_url(raw: Column, base: Column) -> Column:
    """A relative reference resolved against a base; the rare dot segments go through Python's resolver."""

    @F.pandas_udf("string")
    def resolve(r: pd.Series, b: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        def one(x, y):
            try:
                return urljoin(y, x) if x is not None else None
            except ValueError:
                return None

        return pd.Series([one(x, y) if y is not None else x for x, y in zip(r, b, strict=True)], dtype=object)

    return resolve(raw, base)


def normalize_url(raw: Column, base: Column | None = None) -> Column:
    """Struct of ``url`` and ``error``: one of the two is null. Null input is an empty URL.

    Quotes and brackets around it go, a base resolves relative references, ``//`` and
    bare hosts become https; spaces, relative paths, hosts without a dot (but
    localhost), bare document names, other schemes and missing hosts are errors.
    """
    s = trimmed(raw)
    has_scheme = s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    if base is not None:
        s = F.when(~has_scheme & ~s.startswith("//") & (s != ""), joined_url(s, base)).otherwise(s)
    return let(F.when(s.startswith("//"), F.concat(F.lit("https:"), s)).otherwise(s), _judged)


def _judged(s: Column) -> Column:
    has_scheme = s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(//|[^0-9]|$)")
    host = F.regexp_extract(s, r"^[^/?]*", 0)
    endings = "|".join(fixed.DOCUMENT_ENDINGS)
    error = (
        F.when(s == "", "empty")
        .when(s.contains(" "), "spaces")
        .when(~has_scheme & s.rlike(r"^\.\.?[/\\]"), "local path")
        .when(~has_scheme & ~host.contains(".") & (host != "localhost"), "no url")
        .when(~has_scheme & ~s.contains("/") & F.lower(host).rlike(rf"\.({endings})$"), "local path")
    )
    full = F.when(has_scheme, s).otherwise(F.concat(F.lit("https://"), s))
    error = F.coalesce(
        error,
        F.when(~F.lower(full).rlike(r"^https?:"), "scheme").when(F.regexp_extract(full, r"^[A-Za-z]+://(?:[^/?#]*@)?([^/?#:]*|\[[^\]]*\])", 1) == "", "no host"),
    )
    return let(F.struct(full.alias("url"), error.alias("error")), lambda x: F.struct(F.when(x["error"].isNull(), x["url"]).alias("url"), x["error"].alias("error")))


def _encoded(text: Column) -> Column:
    # Spark's encoder leaves the star and escapes the tilde; query strings want it the other way round.
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def canonical_query(query: Column, tracking: bool) -> Column:
    """Pairs with lower-case keys, sorted by key and value, encoded again; without tracking keys unless ``tracking``."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.struct(F.lower(_decoded(F.substring_index(x, "=", 1))).alias("k"), F.when(x.contains("="), _decoded(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("").alias("v")),
    )
    if not tracking:
        pattern = "^(" + "|".join(fixed.TRACKING_KEYS) + ")"
        pairs = F.filter(pairs, lambda p: ~p["k"].rlike(pattern))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def canonical_url(url: Column, query: str = "keep") -> Column:
    """Identity of a page: lower-case scheme and host, one ``www.`` less, no default port, user, fragment, parameters or
    closing slash. ``query``: ``keep`` (sorted), ``drop``, or ``drop-tracking``. Null where the URL isn't one."""
    return let(normalize_url(url)["url"], lambda u: _identity(u, query))


def _identity(u: Column, query: str) -> Column:
    def out(x: Column) -> Column:
        port = F.when((x["port"] == "") | (x["port"] == F.when(x["scheme"] == "http", "80").otherwise("443")), "").otherwise(F.concat(F.lit(":"), x["port"]))
        head = F.concat(x["scheme"], F.lit("://"), x["host"], port, F.when(x["path"] == "", "/").otherwise(x["path"]))
        return head if query == "drop" else let(canonical_query(part(u, 4), query != "drop-tracking"), lambda q: F.when(q == "", head).otherwise(F.concat(head, F.lit("?"), q)))

    authority = F.regexp_replace(part(u, 2), r"^.*@", "")
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r":[0-9]*$", "")), r"^www\.", "")
    path = F.regexp_replace(F.substring_index(part(u, 3), ";", 1), "/+$", "")
    return let(F.struct(F.lower(part(u, 1)).alias("scheme"), host.alias("host"), F.regexp_extract(authority, r":([0-9]+)$", 1).alias("port"), path.alias("path")), out)


def content_hash(text: Column) -> Column:
    """SHA-256 in hex of the text in UTF-8; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def domain_of(url: Column) -> Column:
    """The authority with user and port, case kept; a string without one is its own domain."""
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.when(found == "", url).otherwise(found)


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")


def classify_link(url: Column) -> Column:
    """``document`` if the path ends like one, else ``page``."""
    return F.when(F.lower(path_of(url)).rlike(r"\.(" + "|".join(fixed.DOCUMENT_ENDINGS) + r")$"), "document").otherwise("page")


def skip_reason(url: Column) -> Column:
    """Why a crawl leaves a link out: ``asset``, ``boilerplate`` or null."""
    path = F.lower(path_of(url))
    starts = "|".join(fixed.BOILERPLATE_PATHS)
    return F.when(path.rlike(r"\.(" + "|".join(fixed.ASSET_ENDINGS) + r")$"), "asset").when(path.rlike(rf"^({starts})"), "boilerplate")


def path_prior(url: Column) -> Column:
    """Weight of a link by where its path lies."""
    path = F.lower(path_of(url))
    return F.when(path.rlike("^(" + "|".join(fixed.LIKED_PATHS) + ")"), fixed.LIKED_WEIGHT).when(path.rlike("^(" + "|".join(fixed.DISLIKED_PATHS) + ")"), fixed.DISLIKED_WEIGHT).otherwise(1.0)


def ipv4_number(ip: Column) -> Column:
    """A dotted quad as a long; null for anything else."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    n = sum((F.element_at(parts, i + 1).cast("long") * F.lit(256 ** (3 - i)) for i in range(1, 4)), F.element_at(parts, 1).cast("long") * F.lit(256**3))
    return F.when(ok, n)


def _bound(value: Column, use) -> Column:
    """What ``use`` makes of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def address_number(ip: Column) -> Column:
    """An address as a struct of ``family`` (4 or 6) and the 128 bits ``hi`` and ``lo``; null for anything else.

    IPv4 takes the first 32 bits, also where it is written inside IPv6 (``::ffff:0:0/96``).
    IPv6 may be shortened, end in a dotted quad and name a zone, which doesn't count.
    """
    struct = lambda family, hi, lo: F.struct(F.lit(family).alias("family"), hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))
    four = lambda n: struct(4, F.shiftleft(n.cast("long"), 32), F.lit(0))
    bare = F.lower(F.regexp_replace(ip, "%[^%]+$", ""))

    def halves(bare: Column) -> Column:
        quad = lambda n: F.concat(F.regexp_extract(bare, "^(.*:)[^:]*$", 1), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
        return F.split(_bound(ipv4_number(F.substring_index(bare, ":", -1)), lambda n: F.when(n.isNotNull(), quad(n)).otherwise(bare)), "::")

    groups = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def filled(h: Column) -> Column:
        first, last = groups(h[0]), groups(F.coalesce(F.get(h, F.lit(1)), F.lit("")))
        gap = 8 - F.size(first) - F.size(last)
        return F.when((F.size(h) == 1) & (gap == 0), first).when((F.size(h) == 2) & (gap > 0), F.concat(first, F.array_repeat(F.lit("0"), gap), last))

    def six(g: Column) -> Column:
        digits = F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")
        half = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("long")
        return F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), struct(6, half(1), half(17)))

    def mapped(n: Column) -> Column:
        inside = (n["family"] == 6) & (n["hi"] == 0) & (F.shiftrightunsigned(n["lo"], 32) == 0xFFFF)
        return F.when(inside, four(n["lo"].bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(n)

    long = _bound(_bound(bare, halves), lambda h: _bound(filled(h), lambda g: _bound(six(g), mapped)))
    return F.when(ip.contains(":"), long).otherwise(_bound(ipv4_number(ip), lambda n: F.when(n.isNotNull(), four(n))))


def _within(number: Column, networks: tuple[str, ...]) -> Column:
    """Whether an address of the networks' family lies in one of them."""
    found = F.lit(False)
    for net in map(ipaddress.ip_network, networks):
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        whole, mask = (int(x) << (128 - net.max_prefixlen) for x in (net.network_address, net.netmask))
        same = F.lit(True)
        for half, shift in (("hi", 64), ("lo", 0)):
            bits = mask >> shift & (1 << 64) - 1
            if bits:
                same = same & (number[half].bitwiseAND(F.lit(signed(bits)).cast("long")) == F.lit(signed(whole >> shift & (1 << 64) - 1)).cast("long"))
        found = found | same
    return found


def private_ipv4(ip: Column) -> Column:
    """Whether a dotted quad lies in a private or reserved network; null for anything else."""
    return F.when(ipv4_number(ip).isNotNull(), private_ip(ip))


def private_ip(ip: Column) -> Column:
    """Whether an address, of either family, lies in a private or reserved network; null for anything else."""
    four = lambda n: _within(n, fixed.PRIVATE_V4) & ~_within(n, fixed.PUBLIC_IN_PRIVATE_V4)
    six = lambda n: _within(n, fixed.PRIVATE_V6) & ~_within(n, fixed.PUBLIC_IN_PRIVATE_V6)
    return _bound(address_number(ip), lambda n: F.when(n["family"] == 4, four(n)).when(n["family"] == 6, six(n)))


def fetch_error(url: Column, allow_private: bool = False) -> Column:
    """Why a URL must not be fetched, before its name is resolved; null if nothing speaks against it.

    Names that resolve are checked by joining their addresses: ``operators.graph.public_hosts``.
    """
    if allow_private:
        return F.lit(None).cast("string")
    authority = F.regexp_replace(part(url, 2), r"^.*@", "")
    host = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^\[|\]$", "")
    port = F.regexp_extract(authority, r":([^:\]]*)$", 1)
    inner = "|".join(s.replace(".", r"\.") for s in fixed.INTERNAL_HOSTS)
    return (
        F.when(~F.lower(part(url, 1)).isin("http", "https"), "scheme")
        .when(host == "", "no host")
        .when((bare == "localhost") | bare.rlike(f"({inner})$"), "internal name")
        .when((port != "") & (~port.rlike(r"^[0-9]{1,9}$") | (F.coalesce(port.try_cast("long"), F.lit(0)) > 65535)), "port")
        .when(F.coalesce(private_ip(bare), F.lit(False)), "private address")
    )


def robots_pattern(rule: Column) -> Column:
    """The regular expression of a robots rule: a star is anything, a closing dollar the end; all else is literal."""
    body = F.regexp_replace(rule, r"\$$", "")
    quoted = F.regexp_replace(body, r"([\\.+?^${}()|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(rule.endswith("$"), "$").otherwise(""))
