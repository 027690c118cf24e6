"""Quotes found through positional anchors against the aligner over every paragraph."""

import random

import pytest
from pyspark.sql import functions as F

from sparkquill.functions import alignment as A
from sparkquill.operators import quotes as Q

ROWS = "doc bigint, para_no int, text string"


def table(spark, texts):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], ROWS).repartition(3)


def brute(quote, texts):
    """(verdict, similarity in order) by aligning every paragraph whole."""
    if not any((t or "").strip() for t in texts):
        return "SOURCE_UNAVAILABLE", 0.0
    parts, used = A.segments(quote or "")
    best = max((A.score(quote or "", t or "")[0] for t in texts), default=0.0)
    if not parts or best < A.ALTERED - 1e-12:
        return "NOT_FOUND_IN_SOURCE", None
    return ("ALTERED" if best < A.VERBATIM else "VERBATIM_WITH_PERMITTED_ALTERATIONS" if used else "VERBATIM"), best


def compare(spark, quotes, texts):
    rows = Q.checked(spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string").repartition(2), table(spark, texts)).collect()
    assert sorted(r.item_id for r in rows) == list(range(len(quotes)))
    for r in rows:
        verdict, similarity = brute(quotes[r.item_id], texts)
        assert r.verdict == verdict, (quotes[r.item_id], r)
        if similarity is not None:
            assert abs(r.similarity - similarity) < 2e-4
        if r.doc is not None and r.ends > r.begins:
            shown = A.source_tokens(texts[r.doc])[r.stretches[0]["first"] : r.stretches[-1]["last"]]
            assert A.source_tokens(r.evidence) == shown and texts[r.doc][r.begins : r.ends] == r.evidence
    return {r.item_id: r for r in rows}


def varied(draw, words, texts):
    """Quotes out of the texts, with words changed, left out, put in brackets or behind an ellipsis."""
    out = []
    for _ in range(120):
        source = A.source_tokens(draw.choice(texts))
        n = draw.randint(1, 14)
        at = draw.randint(0, max(0, len(source) - n))
        quote = source[at : at + n]
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
            i = draw.randint(0, len(quote))
            kind = draw.choice(["change", "drop", "add", "bracket", "letter", "gap"])
            if kind == "add":
                quote.insert(i, draw.choice(words))
            elif kind == "gap":
                quote[i : i + 3] = ["..."]
            elif i < len(quote):
                quote[i : i + 1] = {"change": [draw.choice(words)], "drop": [], "bracket": ["[other]"], "letter": [f"[{quote[i][0]}]{quote[i][1:]}"]}[kind]
        out.append(" ".join(quote))
    return out


@pytest.mark.parametrize("seed, vocabulary, sent, loose", [(1, 40, 2_000_000, 256), (2, 6, 2_000_000, 7), (3, 300, 0, 256)])
def test_random_quotes_against_every_paragraph(spark, monkeypatch, seed, vocabulary, sent, loose):
    monkeypatch.setattr(Q, "SENT", sent)
    monkeypatch.setattr(Q, "LOOSE", loose)
    draw = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(vocabulary)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 40))).capitalize() for _ in range(25)]
    compare(spark, varied(draw, words, texts), texts)


def test_every_quote_has_its_row(spark):
    """Null, empty, blank, wordless, unmatched and bracketed quotes, and quotes that repeat."""
    texts = ["The court shall decide the matter.", None, "", "  ", "Another text “altogether” — of many words."]
    quotes = [None, "", "  ", "...", "?!", "[emphasis added]", "nothing is alike", "[T]he", "[he]", "[t]he [c]ourt", "The court shall decide the matter.", "The court shall decide the matter.", "another text \"altogether\""]
    got = compare(spark, quotes, texts)
    assert [got[i].verdict for i in (0, 1, 3, 6, 7, 10, 11, 12)] == ["NOT_FOUND_IN_SOURCE"] * 4 + ["VERBATIM_WITH_PERMITTED_ALTERATIONS", "VERBATIM", "VERBATIM", "VERBATIM"]
    assert got[0].notes == got[3].notes == ["EMPTY_QUOTE"] and got[6].notes == ["SEMANTIC_PROVIDER_REQUIRED"] and got[6].similarity == 0 and got[6].doc is None


def test_without_any_source(spark):
    for texts in ([], [None, " \n"]):
        rows = Q.checked(spark.createDataFrame([(1, "some words"), (None, None)], "item_id int, quote string"), table(spark, texts)).collect()
        assert [(r.verdict, r.similarity, r.notes, r.status) for r in rows] == [("SOURCE_UNAVAILABLE", 0.0, [], "NOT_NEEDED")] * 2
    assert Q.checked(spark.createDataFrame([], "item_id int, quote string"), table(spark, ["a b"])).collect() == []


def test_parts_keep_their_order(spark):
    texts = ["The long argument ended before the judges met and they shall decide today.", "one two three filler four five six filler one two three"]
    got = compare(spark, ["shall decide today ... the long argument ended", "the long argument ... shall decide today", "four five six ... one two three ... four five six"], texts)
    assert [got[i].verdict for i in range(3)] == ["NOT_FOUND_IN_SOURCE", "VERBATIM_WITH_PERMITTED_ALTERATIONS", "NOT_FOUND_IN_SOURCE"]
    assert got[1].evidence == "The long argument ended before the judges met and they shall decide today"


def test_ties_go_to_the_first_paragraph(spark):
    rows = spark.createDataFrame([(5, 1, "we hold so"), (3, 2, "we hold so"), (3, 1, "other"), (3, 7, "we hold so")], ROWS).repartition(4)
    got = Q.checked(spark.createDataFrame([(1, "We hold so")], "item_id int, quote string"), rows).first()
    assert (got.doc, got.para_no) == (3, 2)


def test_scope_pinpoint_and_meaning(spark):
    rows = spark.createDataFrame([(1, 1, "we hold that it is so", "a", 4), (2, 1, "they hold that it is so", "b", 7)], ROWS + ", source string, page int")
    asked = [(1, "we hold that it is so", "a", "at 4-5", None), (2, "we hold that it is so", "b", "9", None), (3, "we hold that it is so", "c", None, 0.99), (4, "quite another thing", "b", None, 0.99), (5, "quite another thing", "a", None, 0.1)]
    got = {r.item_id: r for r in Q.checked(spark.createDataFrame(asked, "item_id int, quote string, source string, pinpoint string, semantic double"), rows, scope="source").collect()}
    assert [got[i].verdict for i in range(1, 6)] == ["VERBATIM", "ALTERED", "SOURCE_UNAVAILABLE", "PARAPHRASE_IN_QUOTES", "NOT_FOUND_IN_SOURCE"]
    assert [got[i].notes for i in range(1, 6)] == [[], ["PINPOINT_MISMATCH"], [], ["SEMANTIC_MATCH"], ["SEMANTIC_NO_MATCH"]]
    assert got[4].similarity == 0.99 and got[4].status == "COMPLETED" and got[2].doc == 2


def test_long_holder_behind_many_short_texts(spark):
    draw = random.Random(4)
    quote = "the court shall decide the matter of the river within seven days"
    long = [f"w{draw.randint(0, 900)}" for _ in range(900)]
    texts = [quote.replace("shall", f"s{i}").replace("seven", f"d{i}").replace("matter", f"m{i}") for i in range(9)]
    texts += [" ".join(long[:500] + [quote] + long[500:]), " ".join(long)]
    got = compare(spark, [quote, "nothing here is alike at all", "[T]he", ""], texts)
    assert [got[i].verdict for i in range(4)] == ["VERBATIM", "NOT_FOUND_IN_SOURCE", "VERBATIM_WITH_PERMITTED_ALTERATIONS", "NOT_FOUND_IN_SOURCE"]
    assert got[0].doc == 9 and got[3].notes == ["EMPTY_QUOTE"]


def test_a_million_words(spark):
    """A paragraph of a million words that holds the quote's parts far from each other, and one that holds half of it."""
    draw = random.Random(7)
    source = [f"w{draw.randint(0, 3000)}" for _ in range(1_000_000)]
    a, b = source[1000:1030], source[900_000:900_030]
    quotes = [" ".join(a) + " ... " + " ".join(b[:10] + ["other"] + b[10:]), " ".join(b) + " ... " + " ".join(a), " ".join(a[:15] + [f"x{i}" for i in range(15)])]
    rows = Q.checked(spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string"), table(spark, [" ".join(source)])).collect()
    got = {r.item_id: r for r in rows}
    assert got[0].verdict == "ALTERED" and [(s["first"], s["last"]) for s in got[0].stretches] == [(1000, 1030), (900_000, 900_030)]
    assert got[1].verdict == got[2].verdict == "NOT_FOUND_IN_SOURCE" and got[2].similarity == 0.5


def test_word_diffs_rebuild_the_source(spark):
    draw = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choice(words) for _ in range(30)) for _ in range(12)]
    quotes = varied(draw, words, texts)
    rows = Q.checked(spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string"), table(spark, texts)).cache()
    by = {}
    for r in Q.diffs(rows).collect():
        by.setdefault(r.item_id, []).append(r)
    for r in rows.where(F.col("stretches").isNotNull()).collect():
        ops = sorted(by.get(r.item_id, []), key=lambda o: o.part)
        stretched = [w for s in r.stretches for w in A.source_tokens(r.paragraph)[s["first"] : s["last"]]]
        assert sorted(w for o in ops for w in o.source_words) == sorted(stretched)
        assert sum(len(o.quote_words) for o in ops) == sum(map(len, A.segments(r.quote)[0]))
        assert all((o.operation == "equal") == (o.quote_words == o.source_words) for o in ops)


def test_the_query_against_every_paragraph(spark, tmp_path):
    """`quote_verdict_benchmark` over forty documents, with items that are null, empty, blank, or long parts of a document."""
    from pyspark.sql import functions as F

    from sparkquill.operators.documents import paragraphs
    from sparkquill.sources.tables import read

    small = "/root/testdata/sf0.001"
    docs = read(spark, small, "documents").where("doc_id < 40")
    lines = paragraphs(docs, "\n").collect()
    items = [(r.item_id, r.text) for r in read(spark, small, "benchmark").collect()] + [(900, None), (901, ""), (902, " "), (903, lines[3].text + "\n" + lines[9].text.upper()), (904, lines[20].text.replace(" ", " the ", 1)), (905, "[x]y zz")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.item_id, r.line): r for r in Q.quote_verdict_benchmark(spark, str(tmp_path)).collect()}
    asked = {(i, n): q for i, t in items for n, q in enumerate((t or "").split("\n") if t else [None])}
    assert set(got) == set(asked)
    texts = [r.text for r in lines]
    for k, q in asked.items():
        verdict, similarity = brute(q, texts)
        assert got[k].verdict == verdict and (similarity is None or abs(got[k].similarity - similarity) < 2e-4)
    assert got[903, 1].verdict == "VERBATIM" and Q.quote_verdict_summary(spark, str(tmp_path)).agg(F.sum("n")).first()[0] == len(asked)


def test_exact_places_as_the_search_gives_them(monkeypatch):
    """A quote that stands as it is has the place and similarity of the search, found without it; and what a batch repeats is aligned once."""
    import pandas as pd
    from sparkquill.functions import alignment
    from sparkquill.operators import verdicts

    words = "a b a b c b a a b c d a b c".split()
    source, cases = alignment.Source(words), [(lo, hi, at, m) for lo in (0, 2) for hi in (9, 14) for at in range(11) for m in (1, 2, 3)]
    pattern = lambda at, m: [(w, None) for w in words[at : at + m]]
    quick = [alignment.align(pattern(at, m), source, lo, hi) for lo, hi, at, m in cases]
    calls, score = [], alignment.score
    monkeypatch.setattr(alignment, "score", lambda q, s: calls.append(q) or score(q, s))
    verdicts.aligned.func(pd.Series(["b c", "b c", None]), pd.Series(["a b c", "a b c", "a"]))
    assert len(calls) == 2
    with monkeypatch.context() as m:
        m.setattr(alignment, "exact", lambda *a: None)
        assert [alignment.align(pattern(at, k), source, lo, hi) for lo, hi, at, k in cases] == quick
    monkeypatch.setattr(alignment, "cheapest", None)
    assert alignment.align(pattern(2, 3), source) == (1.0, 2, 5)


def test_nothing_behind_a_place_as_it_is_is_aligned(spark, monkeypatch):
    """Of a hundred paragraphs that hold a quote as it is, one batch gives its first place alone."""
    from sparkquill.operators import quotes

    rows = spark.createDataFrame([(1, d, 1, "the long rule", "here the long rule stands") for d in range(100)], "tag bigint, doc bigint, para_no int, quote string, text string")
    rows = rows.coalesce(1).selectExpr("*", "array(struct(0 AS part, 0 AS lo, 5 AS hi)) AS windows")
    found = quotes.in_windows(rows, quotes.FOUND.format(doc="bigint")).collect()
    assert [(r.doc, r.similarity, r.first, r.last) for r in found] == [(0, 1.0, 1, 4)]
