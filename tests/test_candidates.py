"""Candidate lists, filters, label documents and stored results against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkquill.operators import candidates as C


def words(t):
    return set(re.findall("[a-z0-9]+", (t or "").lower()))


@pytest.mark.parametrize("k, small", [(24, 24), (32, 0), (3, 3)])
def test_local_lists_against_plain_sorting(spark, k, small):
    draw = random.Random(k)
    held = [(s, s * 1000 + i, " ".join(draw.choice("a b c d e f g h".split()) for _ in range(draw.randint(0, 6)))) for s, n in enumerate([1, 3, 24, 25, 60, 33]) for i in range(n)]
    asked = [(q, draw.randint(0, 7), draw.choice(["a b c", "z", "", None, "A, b; h!"])) for q in range(40)]
    got = {}
    rows = C.local_list(spark.createDataFrame(asked, "q int, source_id int, text string"), spark.createDataFrame(held, "source_id int, para_id int, text string").repartition(5), k, small)
    for r in sorted(rows.collect(), key=lambda r: (r.q, r.nth)):
        got.setdefault(r.q, []).append(r.para_id)
    for q, source, text in asked:
        mine = [(p, len(words(text) & words(t))) for s, p, t in held if s == source]
        order = mine if len(mine) <= small else sorted(mine, key=lambda x: (-x[1], x[0]))
        assert got.get(q, []) == [p for p, _ in order[:k]]


def test_hits_come_before_the_local_list(spark):
    held = spark.createDataFrame([(1, 11, "alpha beta"), (1, 12, "gamma alpha alpha"), (1, 13, "delta"), (2, 21, "x")], "source_id int, para_id int, text string")
    asked = spark.createDataFrame([(1, 1, "Alpha"), (2, 1, "none of them"), (3, 2, None), (4, 9, "alpha")], "q int, source_id int, text string")
    got = {}
    for r in sorted(C.candidates(asked, held).collect(), key=lambda r: (r.q, r.nth)):
        got.setdefault(r.q, []).append((r.para_id, r.found))
    assert got == {1: [(12, True), (11, True)], 2: [(11, False), (12, False), (13, False)], 3: [(21, False)]}


def test_citations_without_findings_are_grey_under_all_checks(spark):
    cites = spark.createDataFrame([(1,), (2,), (3,)], "citation_id int")
    found = spark.createDataFrame([(1, "quote", "ALTERED"), (1, "existence", "VERIFIED"), (2, "quote", None)], "citation_id int, check string, verdict string")
    shown = lambda c, t: sorted(r[0] for r in C.matching(cites, found, F.lit(c), F.lit(t)).collect())
    assert shown("all", "all") == [1, 2, 3] and shown("all", "grey") == [2, 3] and shown("quote", "all") == [1, 2] and shown("quote", "green") == [] and shown("existence", "green") == [1]


def test_label_documents_and_their_errors(spark):
    files = [("a", '{"brief": "One", "x": 1}'), ("b", '{"brief": "ONE", "x": 2}'), ("c", '{"brief": 3}'), ("d", "[1]"), ("e", "no JSON"), ("f", None), ("g", '{"x": 1}'), ("h", '{"brief": null}')]
    labels, errors = C.label_documents(spark.createDataFrame(files, "path string, text string"))
    assert [tuple(r) for r in labels.collect()] == [("one", "b", '{"brief": "ONE", "x": 2}')]
    assert sorted(r.path for r in errors.collect()) == list("cdefgh") and all(r.error.endswith(": " + r.path) for r in errors.collect())


def test_the_first_result_that_exists_is_read(spark, tmp_path):
    paths = [f"file://{tmp_path}/{n}.json" for n in "abc"]
    assert C.stored_result(spark, paths) is None
    (tmp_path / "b.json").write_text('{"dataset": {"labelled": 3, "job_references": {"x": "y"}},\n "quote": {"precision": null}, "n": 2}')
    (tmp_path / "c.json").write_text("[]")
    got = {r.name: json.loads(r.value) for r in C.stored_result(spark, paths).collect()}
    assert got["dataset"] == {"labelled": 3} and got["n"] == 2 and set(got) == {"dataset", "quote", "n"}
    with pytest.raises(Exception, match="evaluation results are invalid"):
        C.stored_result(spark, paths[2:]).collect()


def test_vectors_of_different_sizes_are_an_error(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0], None)], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(C.checked_cosine(F.col("a"), F.col("b"))).collect()][0] == 0.0
    with pytest.raises(Exception, match="vectors of sizes 1 and 2"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(C.checked_cosine(F.col("a"), F.col("b"))).collect()


def test_closing_rows(spark):
    rows = spark.createDataFrame([(1, "q", "R"), (2, "", "R"), (3, None, None)], "citation_id int, quote string, reason string")
    assert sorted((r.citation_id, r.check, r.verdict, r.note) for r in C.closing_rows(rows).collect()) == [
        (1, "proposition", "UNVERIFIABLE", "R"), (1, "quote", "SOURCE_UNAVAILABLE", None), (2, "proposition", "UNVERIFIABLE", "R"), (3, "proposition", "UNVERIFIABLE", None)
    ]


def test_forms_are_hashed_where_they_are_made(spark):
    """Digests of casefolded texts, null ones too; whole texts don't come back from the tasks' Python."""
    import hashlib

    given = [(1, "Straße  X\n"), (2, None), (3, ""), (4, "a" * 100_000), (None, "x")]
    got = C.form_digests(spark.createDataFrame(given, "k int, text string")).collect()
    assert [(r.k, r.form) for r in got] == [(k, t if t is None else hashlib.sha256(" ".join(t.casefold().split()).encode()).hexdigest()) for k, t in given]
    assert "ArrowEvalPython" not in C.citation_forms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_of_scores_against_plain_counts(spark, monkeypatch):
    """Parts and tiles of a few rows give each query's first texts by shared words, of equal ones the lesser id; a pair without a word of both is none."""
    from sparkquill.operators import search

    for name, n in (("TEXTS", 7), ("ASKERS", 5), ("TILE", 3)):
        monkeypatch.setattr(search, name, n)
    words = lambda i: {f"w{(i * i + j * j) % 17}" for j in range(i % 5)}
    texts, asked = {i: words(i) for i in range(60)}, {i: words(i + 3) for i in range(12)}
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(sorted(v))) for k, v in rows.items()], f"{key} long, text string")
    found = search.best(frame(asked, "q"), frame(texts, "c"), "q", "c", shared=4)
    got = {(r.q, r.c, r.overlap, r.rank) for r in search.ranked(found, ["q"], "overlap", "c", 4).collect()}
    want = set()
    for q, a in asked.items():
        order = sorted((-len(a & t), c) for c, t in texts.items() if a & t)[:4]
        want |= {(q, c, -n, i + 1) for i, (n, c) in enumerate(order)}
    assert got == want
