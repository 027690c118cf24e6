"""Upserts into buckets, and the similarity join of names against all pairs."""

import difflib
import os
import random

import pytest

from sparkquill.functions import alignment as A
from sparkquill.operators import names
from sparkquill.sources.upserts import Upserts


def files(path):
    return {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    schema = "k string, seq int, v string, made string"
    table = Upserts(spark, f"file://{tmp_path}/t", ["k"], "seq", ["v"], ["made"], 8)
    first = spark.createDataFrame([(f"k{i}", 1, f"a{i}", "one") for i in range(60)] + [(None, 1, "none", "one")], schema)
    assert table.merge(first) == list(range(8))
    before = files(f"{tmp_path}/t")
    batch = spark.createDataFrame([("k3", 5, "new", "five"), ("k3", 4, "old", "four"), ("k7", 0, "late", "zero"), (None, 9, "still none", "nine")], schema)
    touched = table.merge(batch)
    after = files(f"{tmp_path}/t")
    kept = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    assert 0 < len(touched) <= 3 and kept and all(after.get(f) == before[f] for f in kept)
    rows = lambda: {r.k: (r.v, r.made) for r in table.rows(table.schema(batch)).collect()}
    want = {f"k{i}": (f"a{i}", "one") for i in range(60)} | {"k3": ("new", "one"), "k7": ("a7", "zero"), None: ("still none", "one")}
    assert rows() == want
    table.merge(batch)  # once more
    table.merge(first)
    assert rows() == want
    assert table.merge(batch.limit(0)) == [] and rows() == want


def test_a_key_with_most_of_the_writes(spark, tmp_path):
    table = Upserts(spark, f"file://{tmp_path}/t", ["k"], "id", ["v"], ["v0"], 4)
    rows = spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v", "id AS v0")
    table.merge(rows.repartition(7))
    got = {r.k: (r.v, r.v0) for r in table.rows(table.schema(rows)).where("k = 7").collect()}
    assert got == {7: (29_997, 0)} and table.rows(table.schema(rows)).count() == 20_000 + (7 % 3 == 0)


def brute(forms, least):
    out = {}
    for a in forms:
        for b in forms:
            if a < b:
                r = difflib.SequenceMatcher(None, a, b).ratio()
                if r >= least:
                    out[a, b] = r
    return out


@pytest.mark.parametrize("least, alphabet, longest", [(0.8, "abc", 9), (0.8, "abcdefgh ", 30), (0.7, "ab", 14), (0.95, "abcd", 40), (1.0, "abc", 8)])
def test_similar_names_against_all_pairs(spark, least, alphabet, longest):
    draw = random.Random(longest)
    some = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, longest))) for _ in range(130)]
    some += ["".join(c for c in draw.choice(some) if draw.random() < 0.9) + draw.choice(["", "a", " b"]) for _ in range(130)]
    rows = [(i, n) for i, n in enumerate(some)] + [(900, None), (901, ""), (902, "?!"), (903, some[0].upper() + "!")]
    df = spark.createDataFrame(rows, "id int, name string").repartition(4)
    forms = {A.name_form(n) for _, n in rows if n} - {""}
    got = {(r.a, r.b): r.ratio for r in names.similar(df, "id", "name", least).collect()}
    assert got == brute(forms, least)
    if least == 0.8:
        assert got


def test_bounds_follow_from_the_ratio():
    """Shared runs of random pairs are never fewer than the bound says."""
    draw = random.Random(2)
    for _ in range(4000):
        x = "".join(draw.choice("abcd") for _ in range(draw.randint(1, 16)))
        y = "".join(draw.choice("abcd") if draw.random() < 0.15 else c for c in x if draw.random() < 0.93)
        if not y:
            continue
        r = difflib.SequenceMatcher(None, x, y).ratio()
        if r >= 0.75:
            assert len(y) in names.lengths(len(x), 0.75)
            for q in (1, 2):
                assert len(set(names.numbered(x, q)) & set(names.numbered(y, q))) >= names.shared(len(x), len(y), 0.75, q)


def test_names_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, name string")
    assert names.similar(df, "id", "name").collect() == [] and names.classes(df, "id", "name").collect() == []


def test_links_of_all_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.form: r for r in names.name_links(spark, d).collect()}
    named = [(r.doc_id, A.name_form(r.name)) for r in names.titled(spark, d).collect() if r.name]
    forms = {f for _, f in named if f}
    pairs = brute(forms, 0.8)
    assert set(rows) == forms
    for f in forms:
        mine = [v for p, v in pairs.items() if f in p]
        assert (rows[f].links, rows[f].best) == (len(mine), max(mine, default=None))
        assert rows[f].class_id == min(i for i, g in named if g == f) and rows[f].n == sum(g == f for _, g in named)


def test_names_of_a_block_are_held_against_each_other_by_letters(monkeypatch):
    """Only pairs that the letters and the longest common subsequence allow are matched; all others would take a second for each few thousand."""
    draw = random.Random(8)
    words = ["report", "annual", "of", "the", "board", "minutes", "summary", "letter", "draft", "final", "case", "notes"]
    some = sorted({" ".join(draw.choice(words) for _ in range(4))[:24].strip() for _ in range(600)})
    calls = []
    real = difflib.SequenceMatcher
    monkeypatch.setattr(names.difflib, "SequenceMatcher", lambda *a: calls.append(1) or real(*a))
    got = {(a, b): r for a, b, r in names.pairs_of(some, some, 0.8, True)}
    monkeypatch.undo()
    assert got == brute(some, 0.8) and len(calls) < len(some) ** 2 / 40
    half = len(some) // 2
    assert {p[:2] for p in names.pairs_of(some[half:], some[:half], 0.8, False)} == {p for p in got if p[0] < some[half] <= p[1]}


def test_names_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "HELD", 20)
    draw = random.Random(9)
    some = sorted({"".join(draw.choice("abcd") for _ in range(draw.randint(3, 9))) for _ in range(110)})
    df = spark.createDataFrame(list(enumerate(some)), "id int, name string")
    assert {(r.a, r.b): r.ratio for r in names.similar(df, "id", "name", 0.8).collect()} == brute(some, 0.8)


def test_names_are_compared_many_at_once(monkeypatch):
    """Only pairs with a name of over 64 letters are compared one by one: all others took some 15 microseconds each after the letters' bound."""
    draw = random.Random(10)
    words = ["ensh", "ansh", "thor", "tion", "the", "of", "reten", "heant", "ör", "漢字"]
    some = sorted({" ".join(draw.choice(words) for _ in range(5))[: draw.randint(20, 24)].strip() for _ in range(400)})
    calls = []
    real = names.common_letters
    monkeypatch.setattr(names, "common_letters", lambda x, y: calls.extend(zip(x, y)) or real(x, y))
    got = {(a, b): r for a, b, r in names.pairs_of(some, some[::-1], 0.8, True)}
    assert not calls and got == brute(some, 0.8) and len(got) > 20
    for places, together in ((1 << 22, 1 << 15), (60, 5)):
        monkeypatch.setattr(names, "PLACES", places)
        monkeypatch.setattr(names, "TOGETHER", together)
        mixed = some[::8] + [(a + " " + b)[:n] for a, b, n in zip(some[::9], some[1::9], range(30, 80))] + ["x" * n for n in (63, 64, 65, 66, 200)] + [(a * 4)[:n] for a, n in zip(some[::40], range(58, 72))]
        mixed = sorted(set(mixed))
        calls.clear()
        got = names.pairs_of(mixed, mixed, 0.8, True)
        assert {(a, b): r for a, b, r in got} == brute(mixed, 0.8) and len(got) == len(brute(mixed, 0.8))
        assert calls and all(max(len(a), len(b)) > names.SHORT for a, b in calls)
