"""Host patterns and guarded state machines against plain Python."""

import random
import re

import pytest

from sparkquill.operators import hosts, machines
from sparkquill.operators.documents import glob


def fits(host, pattern):
    if re.search(r"[*?\[]", pattern):
        return bool(re.fullmatch(glob(pattern), host, re.S))
    return host == pattern or host.endswith("." + pattern)


@pytest.mark.parametrize("seed, most", [(1, 50_000), (2, 3)])
def test_hosts_against_every_pattern(spark, monkeypatch, seed, most):
    monkeypatch.setattr(hosts, "GLOBS", most)
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abc") for _ in range(draw.randint(1, 3)))
    some = [".".join(word() for _ in range(draw.randint(1, 4))) for _ in range(80)] + ["", None, "a..b", "a"]
    signs = ["*", "?", "*.", "[ab]", "[!a]", "."]
    patterns = [draw.choice(some[:80]) for _ in range(30)] + ["".join(draw.choice([word(), draw.choice(signs)]) for _ in range(draw.randint(1, 5))) for _ in range(120)] + ["*", "*.*", "?", "", None, "*.a"]
    rows = [(draw.choice(["allow", "deny", "allow"]) if p != "*" else "other", p) for p in patterns]
    h = spark.createDataFrame([(x,) for x in some], "host string").repartition(3)
    p = spark.createDataFrame(rows, "kind string, pattern string")
    want = {(x, q) for x in some if x for q in patterns if q and fits(x, q)}
    assert {(r.host, r.pattern) for r in hosts.matched(h, p).collect()} == want
    kinds = {(k, q) for k, q in rows}
    for r in hosts.decided(h, p).collect():
        n = {k: len({q for kk, q in kinds if kk == k and q and r.host and fits(r.host, q)}) for k in ("allow", "deny")}
        assert (r.allowed, r.denied, r.may_fetch) == (n["allow"], n["deny"], n["allow"] > 0 and n["deny"] == 0)


def test_a_hundred_thousand_patterns(spark):
    patterns = spark.range(100_000).selectExpr("CASE WHEN id % 10 = 0 THEN 'deny' ELSE 'allow' END AS kind", "CASE id % 3 WHEN 0 THEN concat('d', id, '.org') WHEN 1 THEN concat('*.d', id, '.org') ELSE concat('x*d', id, '?org') END AS pattern")
    some = [("d3.org",), ("a.d3.org",), ("d4.org",), ("a.d4.org",), ("xyzd5.org",), ("yd5.org",), ("d30.org",), ("b.d30.org",), ("q.r.d99999.org",), ("none.org",)]
    got = {r.host: r.may_fetch for r in hosts.decided(spark.createDataFrame(some, "host string"), patterns).collect()}
    assert got == {"d3.org": True, "a.d3.org": True, "d4.org": False, "a.d4.org": True, "xyzd5.org": True, "yd5.org": False, "d30.org": False, "b.d30.org": False, "q.r.d99999.org": True, "none.org": False}


def test_without_patterns_nothing_may_be_fetched(spark):
    h, none = spark.createDataFrame([("a.b",)], "host string"), spark.createDataFrame([], "kind string, pattern string")
    assert [tuple(r) for r in hosts.decided(h, none).collect()] == [("a.b", False, 0, 0)]
    assert hosts.decided(h.limit(0), none).collect() == []


def folded(rows):
    out = {}
    for key, at, event in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        state, moved, hit, n = out.get(key, ("queued", 0, 0, 0))
        new = machines.STEPS.get(event, {}).get(state, state)
        out[key] = (new, moved + (new != state), hit + (event == "claim" and new != state), n + 1)
    return out


@pytest.mark.parametrize("part", [10, 100_000])
def test_machines_against_an_ordered_fold(spark, monkeypatch, part):
    monkeypatch.setattr(machines, "SORTED", part)
    draw = random.Random(part)
    events = ["claim", "retry", "claim", "retry", "succeed", "fail", "unknown", None]
    rows = [(draw.choice([1, 1, 1, 2, 3, 4, 5, None]), draw.choice([None, *range(60)]), draw.choice(events[: draw.randint(2, 8)])) for _ in range(400)]
    rows += [(8, t, e) for t, e in enumerate(["fail", "claim", "succeed", "claim", "fail"])]  # terminal, then more
    got = {r.key: (r.state, r.steps, r.counted, r.events) for r in machines.machine(spark.createDataFrame(rows, "key int, at int, event string").repartition(5)).collect()}
    assert got == folded(rows) and got[8] == ("fetched", 2, 1, 5)
    assert machines.machine(spark.createDataFrame([], "key int, at int, event string")).collect() == []
