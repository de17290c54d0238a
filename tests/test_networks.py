"""Addresses as numbers and the longest-prefix join, against Python's own address type."""

import ipaddress
import random

from pyspark.sql import functions as F

from webgrain.functions import fixed, urls
from webgrain.operators.networks import longest_prefix, networks

ODD = [
    None, "", "::", "::1", "1::", ":", ":::", "1:::2", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:",
    "::ffff:1.2.3.4", "::FFFF:10.0.0.1", "::ffff:a00:1", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::ffff:1.2.3", "::ffff:1.2.3.400", "::1.2.3.4:5", "1.2.3.4", "01.2.3.4", "1.2.3", "256.1.1.1", "0.0.0.0", "255.255.255.255",
    "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "%eth0", "FE80::ABCD", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::", "2001:20::5", "2001:db8::1", "192.0.0.9", "1.2.3.4:80", " ::1", "::1 ", "1.2.3.4::", "x",
]


def parsed(v):
    try:
        a = ipaddress.ip_address(v)
    except ValueError:
        return None
    if a.version == 6 and a.ipv4_mapped:
        a = a.ipv4_mapped
    return a


def many(n=2000):
    rng = random.Random(3)
    out = []
    for _ in range(n):
        a = ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 0, 20, 64, 100]) << rng.choice([0, 0, 16, 60]) & (1 << 128) - 1)
        out.append(rng.choice([a.compressed, a.exploded, a.compressed.upper(), str(ipaddress.IPv4Address(rng.getrandbits(32))), f"::ffff:{ipaddress.IPv4Address(rng.getrandbits(32))}"]))
    for net in map(ipaddress.ip_network, (*fixed.PRIVATE_V4, *fixed.PRIVATE_V6, *fixed.PUBLIC_IN_PRIVATE_V4, *fixed.PUBLIC_IN_PRIVATE_V6)):
        for x in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= x < 1 << net.max_prefixlen:
                out.append(str(type(net[0])(x)))
    return out


def test_numbers_and_private_networks(spark):
    values = [*ODD, *many()]
    frame = spark.createDataFrame([(v,) for v in values], "ip string")
    rows = frame.select("ip", urls.address_number(F.col("ip")).alias("n"), urls.private_ip(F.col("ip")).alias("p"), urls.private_ipv4(F.col("ip")).alias("p4")).collect()
    inside = {v: [ipaddress.ip_network(n) for n in getattr(fixed, v)] for v in ("PRIVATE_V4", "PRIVATE_V6", "PUBLIC_IN_PRIVATE_V4", "PUBLIC_IN_PRIVATE_V6")}
    for r in rows:
        a = parsed(r["ip"])
        if a is None:
            assert r["n"] is None and r["p"] is None, r
            continue
        got = (r["n"]["hi"] % (1 << 64) << 64 | r["n"]["lo"] % (1 << 64)) >> (128 - a.max_prefixlen)
        assert (r["n"]["family"], got) == (a.version, int(a)), r
        want = any(a in n for n in inside[f"PRIVATE_V{a.version}"]) and not any(a in n for n in inside[f"PUBLIC_IN_PRIVATE_V{a.version}"])
        assert r["p"] == want, r
        assert r["p4"] == (want if ":" not in r["ip"] else None)


def test_longest_prefix(spark):
    rng = random.Random(5)
    values = [*ODD, *many(600), *["10.1.2.3"] * 50]
    nets = [("0.0.0.0/0", "all"), ("::ffff:0:0/96", "all too"), ("::/0", "six"), ("10.1.2.3", "self"), ("10.0.0.0/33", "no"), ("10.0.0.0/-1", "no"), ("::/129", "no"), ("x/3", "no"), ("1.2.3.4/", "no"), ("1.2.3.4/8/8", "no"), (None, "no"), ("2.0.0.0/8", None), ("3.0.0.0/8", "b"), ("3.9.9.9/8", "a")]
    for v in filter(parsed, rng.sample(values, 300)):
        a = parsed(v)
        nets.append((f"{a}/{rng.randrange(a.max_prefixlen + 1)}", f"v{rng.randrange(99)}"))
    known = {}
    for n, value in nets:
        if n and value not in ("no", None):
            net = ipaddress.ip_network("0.0.0.0/0" if n == "::ffff:0:0/96" else n, strict=False)
            known[net] = min(known.get(net, value), value)
    got = longest_prefix(spark.createDataFrame([(v,) for v in values], "ip string"), networks(spark.createDataFrame(nets, "network string, value string"))).collect()
    assert len(got) == len({*values})
    for r in got:
        a = parsed(r["address"])
        best = max(((n.prefixlen, v) for n, v in known.items() if a is not None and a in n), default=(None, None))
        assert (r["bits"], r["value"]) == best, r
    none = networks(spark.createDataFrame([], "network string, value string"))
    assert all(r["bits"] is None for r in longest_prefix(spark.createDataFrame([("::1",), (None,)], "ip string"), none).collect())


def test_keys_of_any_size_are_spread(spark):
    from webgrain.plans import parts

    keys = [0, 1, 1499, 3475, 90_000, 2**32 - 1, 2**32, 2**53 + 1, 2**62 - 1]
    for weight in (1_000_003, parts._SPREAD, parts._SPREAD_NETS):
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", parts._spread(F.col("k"), weight).alias("n")).collect()
        assert {r["k"]: r["n"] for r in got} == {k: k * weight % 2**32 for k in keys}


def test_networks_of_many_users(spark, tmp_path):
    """User ids from 3475 on once overflowed."""
    from webgrain.plans import parts

    spark.range(50).selectExpr("id AS event_id", "id * 2000 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(400).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    nets = [(k, k * parts._SPREAD_NETS % 2**32, 4 + k % 13, k // 13 % 2) for k in range(400)]
    for r in parts.networks_of_events(spark, str(tmp_path)).collect():
        e = r["event_id"]
        n = (e * 2000 * 1_000_003 + e % 1000) * parts._SPREAD % 2**32
        hits = [(-bits, k) for k, m, bits, f in nets if f == e % 2 and n >> (32 - bits) == m >> (32 - bits)]
        best = min(hits, default=(None, None))
        assert (r["bits"], r["network"]) == ((-best[0] + 32 * (e % 2), best[1]) if hits else (None, None))
