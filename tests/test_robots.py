"""Robots rules found by their literal beginning give what trying all rules gives."""

import random
import re

from webgrain.sources import web


def matches(rule, path):
    body = rule[:-1] if rule.endswith("$") else rule
    return re.match(".*".join(map(re.escape, body.split("*"))) + ("$" if rule.endswith("$") else ""), path)


def test_longest_rule(spark):
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("ab/*$?.") for _ in range(n))
    rules = [(rng.choice("xyz"), rng.random() < 0.5, "/" + some(rng.randint(0, 5))) for _ in range(150)] + [("x", True, "*"), ("x", False, "/a"), ("x", True, "/a"), ("z", False, None)]
    paths = [(h, f"http://{h}/" + "".join(rng.choice("ab/.") for _ in range(rng.randint(0, 7))) + rng.choice(["", "?a", "?b=/a", "#f"])) for h in "xyzw" for _ in range(120)]
    paths += [("x", "http://x"), ("x", "http://x?a"), (None, "http://n/a"), ("x", None)] + paths[:3]
    got = web.robots_allowed(spark.createDataFrame(paths, "host string, url string"), spark.createDataFrame(rules, "host string, allow boolean, path string"))
    assert got.columns == ["host", "url", "allowed"]

    def plain(host, url):
        rest = re.sub("#.*", "", (url or "")[len(f"http://{host}") :])
        path = rest if rest.startswith("/") else "/" + rest
        met = [(len(r), allow) for h, allow, r in rules if h == host and r is not None and url is not None and matches(r, path)]
        return max(met)[1] if met else True

    key = lambda r: [(v is not None, v) for v in r]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((h, u, plain(h, u)) for h, u in paths), key=key)
