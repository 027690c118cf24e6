"""Labels by containment, settings, globs, investigations' inputs and notes of quotes: small and odd cases."""

import json

import pytest
from pyspark.sql import functions as F

from sparkquill.operators import evaluation, investigations, verdicts
from sparkquill.operators.documents import glob, matches
from sparkquill.sources import settings as S

LABELS = "brief string, nth int, citation string, existence string, use string"
SEEN = "brief string, place int, normalized string, raw_text string"


def key(text):
    return "".join((text or "").split()).lower()


def test_containment_matches_brute_force(spark):
    labels = [("a", 1, "337 F.R.D. 659", None, None), ("a", 2, "1 U", None, None), ("a", 3, " ", None, None), ("a", 4, None, None, None), ("b", 1, "337 F.R.D. 659", None, None), (None, 1, "x", None, None)]
    seen = [("a", 1, "fuller v. athleta, llc, 337 f.r.d. 659, 663", None), ("a", 2, None, "Roe, 11\n U.S. 5"), ("a", 3, "", None), ("a", 4, None, None), ("b", 1, "337 F. 3d 659", "1 U"), ("a", 1, "again 337 F.R.D. 659", None)]
    got = {tuple(r) for r in evaluation.met_labels(spark.createDataFrame(labels, LABELS), spark.createDataFrame(seen, SEEN)).collect()}
    want = {(b, n, p) for b, n, c, *_ in labels for b2, p, *texts in seen if b and b == b2 and key(c) and any(key(c) in key(t) for t in texts)}
    assert got == want and want == {("a", 1, 1), ("a", 2, 2)}


def test_evaluation_of_one_label(spark):
    labels = spark.createDataFrame([("p", 1, "1 F.4th 2", "NOT_FOUND_ANYWHERE", "MISREPRESENTED"), ("p", 2, "9 F.4th 9", "VERIFIED", "ACCURATE")], LABELS)
    seen = spark.createDataFrame([("p", 1, "Example v. Example, 1 F.4th 2", None)], SEEN)
    found = [("p", 1, 1, "existence", "NOT_FOUND_ANYWHERE"), ("p", 1, 2, "quote", None), ("p", 1, 3, "quote", "NOT_FOUND_IN_SOURCE"), ("p", 1, 4, "quote", "VERBATIM"), ("p", 1, 5, "proposition", "UNVERIFIABLE")]
    found = spark.createDataFrame(found, "brief string, place int, pos int, check string, verdict string")
    rows = {r["check"]: r for r in evaluation.evaluate(labels, seen, found).collect()}
    assert rows["existence"]["precision"] == 1.0 and rows["existence"]["exact"] == 1 and rows["existence"]["abstained"] == 1
    assert rows["quote"]["recall"] == 1.0 and (rows["proposition"]["abstained"], rows["proposition"]["fn"]) == (2, 1)
    assert evaluation.evaluate(labels.limit(0), seen, found).count() == 0
    assert evaluation.dataset(labels).first().asDict() == {"briefs": 1, "labelled": 2}


def test_settings_are_checked(tmp_path):
    s = S.settings()
    assert (s.verbatim, s.altered, s.searches, s.fetches) == (0.97, 0.8, 3, 5) and s.resolvers[0].name == "ny_reporter_3d"
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"allowed": ["a.example"], "retrieval": {"top_k_paragraphs": 9}}))
    assert S.load(str(path)).allowed == ("a.example",) and S.load(str(path)).paragraphs == 9 and S.load(str(path)).denied == s.denied
    for bad in (
        {"allowed": ["a", 1]}, {"denied": "a"}, {"resolvers": [{"name": "x"}]}, {"resolvers": "x"}, {"retrieval": {"top_k_paragraphs": True}}, {"quote_fidelity": 3},
        {"investigator": {**S.DEFAULTS["investigator"], "official_search_domains": [{"domain": "a"}]}}, {"investigator": {**S.DEFAULTS["investigator"], "name_similarity_threshold": 1.5}},
        {"quote_fidelity": {"verbatim_similarity": 0.5, "altered_similarity_min": 0.8, "paraphrase_semantic_similarity": 0.8}},
    ):
        with pytest.raises(ValueError):
            S.settings(bad)


def test_globs(spark):
    assert [glob(p) for p in ("*.a", "p?", "[!ab]c", "[a-c]", "[")] == [r".*\.a", "p.", "[^ab]c", "[a-c]", r"\["]
    hosts = spark.createDataFrame([("xc.org",), ("ac.org",), ("sub.a.org",), ("a.org",), (None,)], "h string")
    ask = lambda *p: [r[0] for r in hosts.select(matches(F.col("h"), p)).collect()]
    assert ask("[!a]c.org") == [True, False, False, False, False] and ask("a.org") == [False, False, True, True, False] and ask("*.a.org") == [False, False, True, False, False]


def test_phrases_and_mentions(spark):
    rows = [("Example v. State", ["2024 Example Slip Op 1"], "Example Court", 2024, None, "opinions.example.gov"), ("", None, None, None, None, None), ("Roe", [], "", None, "23-1", None)]
    df = spark.createDataFrame(rows, "name string, parties array<string>, court string, year int, docket string, domain string")
    got = [r[0] for r in df.select(investigations.search_phrases(*[F.col(c) for c in df.columns])).collect()]
    assert got == [
        ["Example v. State 2024 Example Slip Op 1 Example Court 2024", "Example v. State Example Court 2024", "site:opinions.example.gov Example v. State 2024 Example Slip Op 1"], [], ["Roe 23-1", "Roe"],
    ]
    hits = spark.createDataFrame([("Example v. State — N.D. Example, 2024", None, "example V. state ", None, 2024), ("Example", "v", "Other", "x", 1), ("a", None, "", "a", None), (None, "roe in court", "Roe", "Court", None)], "t string, s string, n string, c string, y int")
    assert [r[0] for r in hits.select(investigations.is_mention(*[F.col(c) for c in hits.columns])).collect()] == [True, False, False, True]


def test_decision_moments(spark):
    days = ["2025-09-16", "2025-09-16T01:00:00Z", "2025-09-16T01:00+01:00", "2025-09-16 01:00:00.25", "", None, "soon", "2025-13-01", "2025-02-30"]
    df = spark.createDataFrame([(x,) for x in days], "v string")
    got = [r[0] for r in df.select(F.unix_micros(investigations.decision_moment(F.col("v")))).collect()]
    day = 1757980800_000_000
    assert got == [day, day + 3600_000_000, day, day + 3600_250_000] + [None] * 5


def test_cache_is_rewritten_by_the_first_that_settles_it(spark):
    cites = spark.createDataFrame([(1, "k", "Poe", 1759), (2, "k", "Doe v. Roe", 1759), (3, "k", "Poe", None), (4, "z", "Doe v. Roe", 1759), (5, None, "Doe v. Roe", None)], "seq int, cite string, case_name string, year int")
    cache = spark.createDataFrame([("k", 300), ("z", 404)], "cite string, status int")
    clusters = spark.createDataFrame([("k", 7, "DOE V ROE", None, None), ("k", 8, "Other", None, None)], "cite string, id int, name string, name_full string, day string")
    got = sorted(tuple(r) for r in investigations.cache_rewrite(cites, cache, clusters).collect())
    assert got == [(1, "k", 300, None), (2, "k", 200, 7), (3, "k", 200, 7), (4, "z", 404, None), (5, None, None, None)]


def test_notes_of_quotes(spark):
    text = "The Court shall decide the matter."
    rows = [
        ("same", text, 1, text, None, 12, "at 12-14"), ("other page", text, 1, "Nothing is here.", None, 12, "at 12"), ("other page", text, 2, text, None, 13, "at 12"), ("no page", text, 1, text, None, None, "at 12"),
        ("no pin", text, 1, text, None, 12, None), ("no number", text, 1, text, None, 12, "passim"), ("empty", "", 1, text, None, 12, "13"), ("no source", text, 1, " ", None, 12, "13"),
        ("meaning", "Nothing here is alike at all.", 1, text, 0.91, 12, "13"), ("no meaning", "Nothing here is alike at all.", 1, text, 0.2, 12, "13"), ("not asked", "Nothing here is alike at all.", 1, text, None, 12, "13"),
    ]
    df = spark.createDataFrame(rows, "case string, quote string, order int, paragraph string, semantic double, page int, pinpoint string")
    got = {r["case"]: (r["notes"], r["status"], r["similarity"]) for r in verdicts.check_quotes(df, ["case"]).collect()}
    assert {c: got[c][0] for c in ("same", "no page", "no pin", "no number", "no source")} == dict.fromkeys(("same", "no page", "no pin", "no number", "no source"), [])
    assert got["other page"] == (["PINPOINT_MISMATCH"], "NOT_NEEDED", 1.0) and got["empty"][:2] == (["EMPTY_QUOTE"], "NOT_CONFIGURED")
    assert got["meaning"] == (["SEMANTIC_MATCH"], "COMPLETED", 0.91) and got["no meaning"][:2] == (["SEMANTIC_NO_MATCH"], "COMPLETED") and got["not asked"][:2] == (["SEMANTIC_PROVIDER_REQUIRED"], "NOT_CONFIGURED")


def test_lookups_of_odd_answers(spark):
    rows = [(1, None), (2, "null"), (3, '[{"status":"x","citation":"a"}]'), (4, '[{"status":200}]'), (5, '[{"status":200,"citation":"a","end_index":"z"}]'), (6, '[{"status":300,"citation":"a","start_index":2}]'), (7, "[]"), (8, "[[]]")]
    got = sorted((tuple(r) for r in investigations.parsed_lookups(spark.createDataFrame(rows, "batch int, answer string")).collect()), key=str)
    bad = [(n, None, None, None, None, None, "UNAVAILABLE") for n in (1, 2, 3, 4, 5, 8)]
    assert got == sorted([*bad, (6, 0, "a", 300, 2, 0, None)], key=str)


def test_briefs_of_few_and_of_many_labels(spark):
    """Briefs of up to FEW labels, whose citations make no grams, and others; short keys, repeats and nulls in both."""
    labels = [(b, i, f"{i} U.S. {b}") for b, n in ((1, 5), (2, evaluation.FEW), (3, evaluation.FEW + 1)) for i in range(n)]
    labels += [(b, 900, "7") for b in (1, 3)] + [(b, 901, " ") for b in (1, 3)] + [(1, 0, "0 U.S. 1")]
    seen = [(b, i, f"Roe, {i} u.s. {b}, 12" if i % 2 else None, f"Roe,\n{i}  U.S. {b}" if i % 3 else None) for b in (1, 2, 3) for i in range(80)]
    form = lambda x: "".join((x or "").split()).lower()
    want = {(b, n, p) for b, n, c in labels for b2, p, *texts in seen if b == b2 and form(c) and any(x is not None and form(c) in form(x) for x in texts)}
    got = evaluation.met_labels(spark.createDataFrame(labels, "brief int, nth int, citation string"), spark.createDataFrame(seen, "brief int, place int, normalized string, raw_text string"))
    rows = [tuple(r) for r in got.select("brief", "nth", "place").collect()]
    assert set(rows) == want and len(rows) == len(want)
