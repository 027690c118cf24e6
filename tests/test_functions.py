"""Scalar functions, the aligner and plans."""

import pytest
from pyspark.sql import functions as F

from sparkquill.functions import alignment as A
from sparkquill.functions import text as T
from sparkquill.functions.verdict_terms import tone
from sparkquill.operators.documents import paragraphs


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


@pytest.mark.parametrize(
    "url, host",
    [("https://A.Example.com./x", "a.example.com"), ("http://h:80/?q", "h"), ("ftp://h/", None), ("https://u:p@h/", None), ("file:///etc", None), ("", None), (None, None)],
)
def test_host(spark, url, host):
    assert one(spark, url, T.host(F.col("x"))) == host


def test_redaction(spark):
    text = "key sk-abcdefghijklmnop at postgres://u:p@h/db or C:\\temp\\x and a.b@c.org"
    assert one(spark, text, T.redact(F.col("x"))) == "key [redacted secret] at [redacted connection string] or [redacted local path] and [redacted email]"


def test_denied_words(spark):
    assert one(spark, "Fake and FABRICATED, AI-generated; honest", T.denied_words(F.col("x"))) == ["AI-generated", "FABRICATED", "Fake"]


def test_page_form(spark):
    assert one(spark, "The court’s well-\nreasoned — opinion  \ncontrols.\n", T.page_form(F.col("x"))) == "The court's wellreasoned - opinion controls."


def test_page_form_of_other_quotes_and_spaces(spark):
    assert one(spark, "\u201eA\u201f \u201ab\u201b\u00a0 c\u2032 d\u2015e\u2003", T.page_form(F.col("x"))) == "\"A\" 'b' c\u2032 d\u2015e"


def test_label(spark):
    from sparkquill.functions.verdict_terms import label

    assert [one(spark, v, label(F.col("x"))) for v in ("ALTERED", "VERIFIED_OFFICIAL", None)] == ["The quoted language differs from the source material reviewed", "Verified official", None]


def test_paragraphs_lose_breaks_and_tabs_at_their_ends(spark):
    rows = spark.createDataFrame([(1, "\nA\n\n\tB \n\n\t")], "doc_id int, text string")
    assert [tuple(r) for r in paragraphs(rows).orderBy("para_no").collect()] == [(1, 1, "A"), (1, 2, "B")]


def test_paragraphs(spark):
    rows = spark.createDataFrame([(1, " 0 a \n\n\n b1 "), (2, ""), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in paragraphs(rows).orderBy("para_no").collect()] == [(1, 1, "0 a"), (1, 2, "b1")]


def test_tone(spark):
    assert [one(spark, v, tone(F.col("x"))) for v in ("VERBATIM", "ALTERED", "CONTRADICTS", "PENDING", "", None)] == ["green", "yellow", "red", "grey", "grey", "grey"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def similarities(pattern, source):
    """Of every stretch, by trying all."""
    return {(i, j): 1 - edits(pattern, source[i:j]) / max(len(pattern), j - i, 1) for i in range(len(source) + 1) for j in range(i, len(source) + 1)}


def test_alignment_finds_the_nearest_of_all_stretches():
    import random

    draw = random.Random(3)
    for _ in range(400):
        source = [draw.choice("abcd") for _ in range(draw.randint(1, 9))]
        pattern = [draw.choice("abcd") for _ in range(draw.randint(1, 5))]
        found, first, end = A.align([(w, None) for w in pattern], A.Source(source))
        every = similarities(pattern, source)
        assert abs(found - max(every.values())) < 1e-6 and abs(every[first, end] - found) < 1e-6


def test_longer_stretch_may_be_nearer():
    """Four words more after the fourth: the window of 22 reaches ALTERED."""
    words = [f"w{i}" for i in range(18)]
    assert round(A.score(" ".join(words), " ".join([*words[:4], "a", "b", "c", "d", *words[4:]]))[0], 4) == 0.8182


def test_parts_in_order_against_all_orders():
    import random

    draw = random.Random(4)
    for _ in range(150):
        source = [draw.choice("abc") for _ in range(draw.randint(2, 9))]
        parts = [[draw.choice("abc") for _ in range(draw.randint(1, 3))] for _ in range(2)]
        one, two = (similarities(p, source) for p in parts)
        best = max((min(x, y) for (_, e), x in one.items() for (b, _), y in two.items() if e <= b), default=0)
        got = A.ordered([[(w, None) for w in p] for p in parts], A.Source(source))
        assert (got is None and best < A.ALTERED) or abs(got[0] - best) < 1e-3


def test_word_diff():
    parts = A.segments("The Court unanimously held ... [t]he rule")[0]
    assert A.diff_rows(parts, [["the", "court", "held"], ["the", "law"]]) == [
        (0, "equal", ["the", "court"], ["the", "court"]), (0, "delete", ["unanimously"], []), (0, "equal", ["held"], ["held"]), (1, "equal", ["the"], ["the"]), (1, "replace", ["rule"], ["law"])
    ]


def test_alignment_in_a_long_source():
    """300,000 words and a quote of 300, with edits: whole numbers leave no rounding to go wrong."""
    import random

    draw = random.Random(8)
    for _ in range(2):
        source = [f"w{draw.randint(0, 5000)}" for _ in range(300_000)]
        quote = source[200_000:200_300]
        quote[50], quote[150:153] = "other", []
        found, first, end = A.align([(w, None) for w in quote], A.Source(source))
        assert (first, end) == (200_000, 200_300) and abs(found - (1 - 4 / 300)) < 1e-12


def test_spans_give_the_words_back():
    import random

    draw = random.Random(6)
    pieces = ["The", " ", "\n", "-\n", "ﬁne", "“", "”", "ß", "é", "e\u0301", "İ", "[12]", "*", "†", " ", "가", "\u1100\u1161", "ｆｕｌｌ", "'", "x’s", "—", "…", "Ⅷ", "½"]
    for _ in range(500):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 14)))
        words, spans = A.source_spans(text)
        assert words == A.source_tokens(text) and all(0 <= a < b <= len(text) for a, b in spans)
        assert [a for a, _ in spans] == sorted(a for a, _ in spans)
    assert A.source_spans("The “inter-\nrupted” rule")[1] == [(0, 3), (5, 18), (20, 24)]


def test_normal_quote_form():
    assert A.plain("The “inter-\nrupted” rule [12] applies.") == 'the "interrupted" rule applies.'


def test_no_cartesian_product(spark):
    from sparkquill import catalogue

    for name in ("bm25_topk", "benchmark_containment", "knn_cosine", "offset_range_join", "evidence_table"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan
