"""Checks of quotes, existence and propositions, and their evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkquill.functions import alignment as A
from sparkquill.sources.settings import settings
from sparkquill.sources.tables import dealt, dealt_sql, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ALIGNED = T.StructType(
    [T.StructField("similarity", T.DoubleType()), T.StructField("closest", T.DoubleType()), T.StructField("altered", T.BooleanType()),
     T.StructField("nearest", T.StringType()), T.StructField("words", T.IntegerType())]
)


@F.pandas_udf(ALIGNED)
def aligned(quote, source):
    # pairs that a batch repeats are aligned once
    known = {(q or "", s or ""): None for q, s in zip(quote, source)}
    for q, s in known:
        known[q, s] = (*A.score(q, s), sum(map(len, A.segments(q)[0])))
    return pd.DataFrame([known[q or "", s or ""] for q, s in zip(quote, source)], columns=["similarity", "closest", "altered", "nearest", "words"])


def quote_ladder(similarity: Column, altered: Column, has_source: Column, words: Column, semantic: Column) -> Column:
    """Verdict of a quote from its best alignment; semantic similarity only counts below the thresholds of alignment."""
    return (
        F.when(~has_source, "SOURCE_UNAVAILABLE")
        .when(words == 0, "NOT_FOUND_IN_SOURCE")
        .when(similarity >= A.VERBATIM, F.when(altered, "VERBATIM_WITH_PERMITTED_ALTERATIONS").otherwise("VERBATIM"))
        .when(similarity >= A.ALTERED, "ALTERED")
        .when(semantic >= A.PARAPHRASE, "PARAPHRASE_IN_QUOTES")
        .otherwise("NOT_FOUND_IN_SOURCE")
    )


def pinpoint_page(pinpoint: Column) -> Column:
    """The first number of a pinpoint; null without one."""
    return F.regexp_substr(pinpoint, F.lit(r"[0-9]+")).try_cast("int")


def quote_notes(verdict: Column, words: Column, semantic: Column, asked: Column, page: Column) -> Column:
    """Array of notes: a page that isn't the pinpoint's for quotes that were found, else what the meaning says, or that it wasn't compared."""
    found = verdict.isin("VERBATIM", "VERBATIM_WITH_PERMITTED_ALTERATIONS", "ALTERED")
    note = (
        F.when(verdict == "SOURCE_UNAVAILABLE", F.lit(None)).when(words == 0, "EMPTY_QUOTE").when(found, F.when(asked != page, "PINPOINT_MISMATCH"))
        .when(verdict == "PARAPHRASE_IN_QUOTES", "SEMANTIC_MATCH").when(semantic.isNotNull(), "SEMANTIC_NO_MATCH").otherwise("SEMANTIC_PROVIDER_REQUIRED")
    )
    return F.array_compact(F.array(note))


def semantic_status(verdict: Column, words: Column, semantic: Column) -> Column:
    """Whether meanings were compared; where the words or the missing source decide, it isn't needed."""
    by_words = verdict.isin("SOURCE_UNAVAILABLE", "VERBATIM", "VERBATIM_WITH_PERMITTED_ALTERATIONS", "ALTERED")
    return F.when(by_words, "NOT_NEEDED").when((words > 0) & semantic.isNotNull(), "COMPLETED").otherwise("NOT_CONFIGURED")


def check_quotes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict, similarity, nearest, notes, status) of pairs (keys, quote, order, paragraph, semantic, perhaps page and pinpoint).

    The best paragraph wins, the earlier one in a tie, and its page is held against the first number of the key's pinpoint; where either is null
    nothing is noted. Only candidate pairs get here; the aligner runs once for each. A paraphrase has its meaning's similarity.
    """
    a = aligned(F.col("quote"), F.col("paragraph"))
    given = lambda name, kind: F.col(name) if name in pairs.columns else F.lit(None).cast(kind)
    each = pairs.withColumn("a", a).withColumn("blank", F.trim(F.coalesce("paragraph", F.lit(""))) == "")
    each = each.withColumn("a", F.struct("a.*", given("page", "int").alias("page")))
    best = F.max_by(F.col("a"), F.struct(F.round("a.similarity", 9), F.round("a.closest", 9), -F.col("order")))
    out = each.groupBy(*keys).agg(
        best.alias("a"), F.bool_or(~F.col("blank")).alias("has"), F.max("semantic").alias("semantic"), F.min(pinpoint_page(given("pinpoint", "string"))).alias("asked")
    )
    words, semantic = F.col("a.words"), F.col("semantic")
    out = out.withColumn("verdict", quote_ladder(F.col("a.similarity"), F.col("a.altered"), F.col("has"), words, F.coalesce(semantic, F.lit(-1.0))))
    verdict = F.col("verdict")
    similarity = F.when(verdict == "PARAPHRASE_IN_QUOTES", semantic).otherwise(F.col("a.closest"))
    return out.select(
        *keys, "verdict", F.round(similarity, 4).alias("similarity"), F.col("a.nearest").alias("nearest"),
        quote_notes(verdict, words, semantic, F.col("asked"), F.col("a.page")).alias("notes"), semantic_status(verdict, words, semantic).alias("status"),
    )


# fixed values: quotes, source paragraphs and what the check says
CASES = (
    ("identical", "The Court shall decide matter {k}.", "The Court shall decide matter {k}.", None, "VERBATIM"),
    ("bracket", "[T]he Court shall decide.", "The Court shall decide.", None, "VERBATIM_WITH_PERMITTED_ALTERATIONS"),
    ("emphasis", "The Court shall decide. [emphasis added]", "The Court shall decide.", None, "VERBATIM_WITH_PERMITTED_ALTERATIONS"),
    ("ellipsis", "The Court ... shall decide today.", "The Court after long argument shall decide today.", None, "VERBATIM_WITH_PERMITTED_ALTERATIONS"),
    ("out_of_order", "shall decide today ... the long argument ended", "The long argument ended before the judges met and they shall decide today.", None, "NOT_FOUND_IN_SOURCE"),
    ("inserted", "The Court unanimously shall decide the matter.", "The Court shall decide the matter.", None, "ALTERED"),
    ("smart", "The “inter-\nrupted” rule [12] applies.", 'The "interrupted" rule applies.', None, "VERBATIM"),
    ("unrelated", "Nothing here is alike at all.", "The Court shall decide the matter.", None, "NOT_FOUND_IN_SOURCE"),
    ("paraphrase", "Nothing here is alike at all.", "The Court shall decide the matter.", 0.91, "PARAPHRASE_IN_QUOTES"),
    ("no_paraphrase", "Nothing here is alike at all.", "The Court shall decide the matter.", 0.20, "NOT_FOUND_IN_SOURCE"),
    ("empty_source", "The Court shall decide.", "  ", None, "SOURCE_UNAVAILABLE"),
    ("longer", "one two three four five six seven eight nine ten", "one two", None, "NOT_FOUND_IN_SOURCE"),
    ("empty_quote", "", "The Court shall decide.", None, "NOT_FOUND_IN_SOURCE"),
)
CASES_SQL = dealt_sql("customer", "c_custkey", [(c[0], c[4]) for c in CASES], '"case", verdict')


@query(CASES_SQL)
def quote_verdict_fixtures(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "customer", "c_custkey", [c[:4] for c in CASES], "case string, quote string, paragraph string, semantic double")
    return check_quotes(rows.withColumn("order", F.lit(1)), ["k", "case"]).select("k", "case", "verdict")


@query(
    """SELECT item_id, item_id % 4 = 3 AS missing, CASE WHEN item_id % 4 = 3 THEN CASE WHEN item_id % 8 = 3 THEN 'SEMANTIC_PROVIDER_REQUIRED' ELSE 'SEMANTIC_NO_MATCH' END
      WHEN item_id % 5 <> item_id % 3 AND item_id % 4 <> 2 THEN 'PINPOINT_MISMATCH' ELSE '' END AS notes,
    CASE WHEN item_id % 4 <> 3 THEN 'NOT_NEEDED' WHEN item_id % 8 = 3 THEN 'NOT_CONFIGURED' ELSE 'COMPLETED' END AS status FROM benchmark"""
)
def quote_pinpoints(spark: SparkSession, d: str) -> DataFrame:
    """Passages held against themselves, as the paragraphs of a page, or against a paragraph without any of their words."""
    k, text = F.col("item_id"), F.col("text")
    pages = read(spark, d, "benchmark").select(
        "item_id", text.alias("quote"), F.lit(1).alias("order"), F.when(k % 4 == 3, "0 1 2 3").otherwise(text).alias("paragraph"),
        F.when(k % 8 == 7, 0.5).alias("semantic"), (k % 5).cast("int").alias("page"), F.when(k % 4 != 2, F.concat(F.lit("at "), k % 3, F.lit("-9"))).alias("pinpoint"),
    )
    missing = F.col("verdict") == "NOT_FOUND_IN_SOURCE"
    return check_quotes(pages, ["item_id"]).select("item_id", missing.alias("missing"), F.array_join("notes", ",").alias("notes"), "status")


@F.pandas_udf(T.DoubleType())
def name_similarity(a, b):
    return pd.Series([A.name_similarity(x, y) for x, y in zip(a, b)])


@query(
    dealt_sql("customer", "c_custkey", [("name only", 1.0, False), ("court", 1.0, True), ("year", 1.0, True), ("docket", 1.0, True), ("other name", 0.7333, False)], "kind, similarity, accepted")
)
def match_candidate(spark: SparkSession, d: str) -> DataFrame:
    """A found source is accepted if its name is near and court, year or docket agree."""
    cite = ("Smith v. Jones, Inc.", "S.D.N.Y.", 2020, "{k}-100")
    rows = [
        ("name only", "SMITH V JONES INC", None, None, None), ("court", "SMITH V JONES INC", "S.D.N.Y.", None, None),
        ("year", "SMITH V JONES INC", None, "2020-05-01", None), ("docket", "SMITH V JONES INC", None, None, "{k} 100"),
        ("other name", "Smith v. James", "S.D.N.Y.", None, None),
    ]
    found = dealt(spark, d, "customer", "c_custkey", [(*r, *cite) for r in rows], "kind string, name string, court string, day string, docket string, c_name string, c_court string, c_year int, c_docket string")
    return accepted(found).select("k", "kind", F.round("similarity", 4).alias("similarity"), "accepted")


def accepted(found: DataFrame, least: float = settings().name_similarity) -> DataFrame:
    """found with similarity and accepted: sources (name, court, day, docket) whose name is near the citation's (c_name), and whose court, year or docket agrees (c_court, c_year, c_docket).

    Courts agree as words, dockets as letters and digits, a year where the day has it standing alone. What is null or empty agrees with nothing.
    """
    form = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    same = lambda a, b: F.coalesce((a == b) & (a != ""), F.lit(False))
    year = same(F.regexp_extract("day", r"(?<!\d)(\d{4})(?!\d)", 1), F.col("c_year").cast("string"))
    agrees = same(form("court"), form("c_court")) | year | same(key("docket"), key("c_docket"))
    out = found.withColumn("similarity", name_similarity("name", "c_name"))
    return out.withColumn("accepted", (F.col("similarity") >= least) & agrees)


@query(
    """SELECT o_orderkey, o_orderkey % 5 > 0 AS near, o_orderkey % 5 > 0 AND (o_orderkey % 4 = 1 OR o_orderkey % 3 = 0 OR o_orderkey % 7 = 0) AS accepted FROM orders"""
)
def candidate_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sources found, of whose facts some agree with those of their citation."""
    k, c, year = F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate")
    found = read(spark, d, "orders").select(
        k, F.when(k % 5 > 0, F.concat(F.lit("CASE V "), c)).otherwise("Unlike").alias("name"), F.when(k % 4 == 1, "S.D.N.Y.").when(k % 4 == 2, "").alias("court"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(k % 7 == 0, "23 100").otherwise("99").alias("docket"), F.concat(F.lit("Case v. "), c).alias("c_name"),
        F.when(k % 4 == 2, " ").otherwise("S. D. N. Y.").alias("c_court"), F.when(k % 3 == 0, year).otherwise(year + 1).alias("c_year"), F.lit("23-100").alias("c_docket"),
    ).withColumn("c_court", F.replace("c_court", F.lit("S. D. N. Y."), F.lit("s.d.n.y")))
    return accepted(found).select("o_orderkey", (F.col("similarity") >= 0.8).alias("near"), "accepted")


def existence(cites: DataFrame, lookups: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cite, status, verdict, id) of citations (cite, case_name, year) from answers of a lookup (cite, status) and the clusters that it named.

    One cluster found verifies a citation. Of several, the only one of the citation's very name whose day is in its year does. What isn't
    found, ambiguous or malformed is PENDING, as others may find it; any other status, or none, is UNVERIFIABLE. Repeated answers to a
    citation count as one, of the least status.
    """
    from sparkquill.operators.passages import settled

    status = lookups.groupBy("cite").agg(F.min("status").alias("status"))
    only = clusters.groupBy("cite").agg(F.min("id").alias("only"))
    known = settled(cites, clusters).join(status, "cite", "left").join(only, "cite", "left")
    s = F.col("status")
    verdict = F.when((s == 200) | (s == 300) & F.col("id").isNotNull(), "VERIFIED").when(s.isin(300, 404, 400), "PENDING").otherwise("UNVERIFIABLE")
    return known.select("cite", "status", verdict.alias("verdict"), F.when(s == 200, F.col("only")).when(s == 300, F.col("id")).alias("id"))


@query(
    """WITH c AS (SELECT o_orderkey AS cite, 'Case v. ' || (o_custkey % 50) AS name, year(o_orderdate) AS y FROM orders),
    l AS (SELECT l_orderkey AS cite, l_linenumber AS id, 'CASE V ' || (l_suppkey % 50) AS name, year(l_shipdate) AS y FROM lineitem),
    n AS (SELECT cite, CASE WHEN cite % 11 = 0 THEN 404 WHEN cite % 13 = 0 THEN 503 WHEN cite % 17 = 0 THEN NULL WHEN count(*) = 1 THEN 200 ELSE 300 END AS status, min(id) AS one_id FROM l GROUP BY cite),
    f AS (SELECT c.cite, min(l.id) AS id FROM c JOIN l ON l.cite = c.cite AND lower(replace(c.name, 'v.', 'v')) = lower(l.name) AND c.y = l.y GROUP BY c.cite HAVING count(*) = 1)
    SELECT cite, status, CASE WHEN status = 200 OR status = 300 AND id IS NOT NULL THEN 'VERIFIED' WHEN status IN (300, 404, 400) THEN 'PENDING' ELSE 'UNVERIFIABLE' END AS verdict,
    CASE WHEN status = 200 THEN one_id WHEN status = 300 THEN id END AS id FROM c LEFT JOIN n USING (cite) LEFT JOIN f USING (cite)"""
)
def existence_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Lookup status to verdict: orders as citations, their line items as the clusters that a lookup named."""
    cites = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("cite"), F.concat(F.lit("Case v. "), F.col("o_custkey") % 50).alias("case_name"), F.year("o_orderdate").alias("year")
    )
    clusters = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("cite"), F.col("l_linenumber").alias("id"), F.concat(F.lit("CASE V "), F.col("l_suppkey") % 50).alias("name"),
        F.lit(None).cast("string").alias("name_full"), F.col("l_shipdate").cast("date").cast("string").alias("day"),
    )
    k = F.col("cite")
    status = F.when(k % 11 == 0, 404).when(k % 13 == 0, 503).when(k % 17 == 0, F.lit(None)).when(F.col("n") == 1, 200).otherwise(300)
    lookups = clusters.groupBy("cite").agg(F.count("*").alias("n")).select("cite", status.alias("status"))
    return existence(cites, lookups, clusters)


# fixed values: parts of the evidence, answers of a judge as JSON, and what the validator says
PARTS = {"p1": "majority", "p2": "dissent", "p3": "concurrence", "p4": "unknown"}
ANSWERS = (
    ("supports", '{"verdict":"SUPPORTS","cited_paragraph_ids":["p1"],"rationale":"r","confidence":0.9}', "SUPPORTS", None),
    ("dissent", '{"verdict":"SUPPORTS","cited_paragraph_ids":["p2","p3"],"rationale":"r","confidence":0.9}', "PARTIAL", None),
    ("unknown part", '{"verdict":"SUPPORTS","cited_paragraph_ids":["p4"],"rationale":"r","confidence":0.9}', "SUPPORTS", None),
    ("not addressed", '{"verdict":"NOT_ADDRESSED","cited_paragraph_ids":[],"rationale":"r","confidence":0.9}', "NOT_ADDRESSED", None),
    ("no object", "[1]", "UNVERIFIABLE", "INVALID_JUDGE_OUTPUT"),
    ("no JSON", "not JSON", "UNVERIFIABLE", "INVALID_JUDGE_OUTPUT"),
    ("own verdict", '{"verdict":"UNVERIFIABLE","cited_paragraph_ids":["p1"],"rationale":"r","confidence":0.9}', "UNVERIFIABLE", "INVALID_VERDICT"),
    ("long rationale", '{"verdict":"SUPPORTS","cited_paragraph_ids":["p1"],"rationale":"' + "x" * 301 + '","confidence":0.9}', "UNVERIFIABLE", "INVALID_RATIONALE"),
    ("text as number", '{"verdict":"SUPPORTS","cited_paragraph_ids":["p1"],"rationale":"r","confidence":"0.8"}', "UNVERIFIABLE", "INVALID_CONFIDENCE"),
    ("no number", '{"verdict":"SUPPORTS","cited_paragraph_ids":["p1"],"rationale":"r","confidence":null}', "UNVERIFIABLE", "INVALID_CONFIDENCE"),
    ("no list", '{"verdict":"SUPPORTS","cited_paragraph_ids":"p1","rationale":"r","confidence":0.9}', "UNVERIFIABLE", "INVALID_CITED_PARAGRAPH_IDS"),
    ("number as id", '{"verdict":"SUPPORTS","cited_paragraph_ids":["p1",4],"rationale":"r","confidence":0.9}', "UNVERIFIABLE", "INVALID_CITED_PARAGRAPH_IDS"),
    ("verdict", '{"verdict":"MAYBE","cited_paragraph_ids":["p1"],"rationale":"r","confidence":0.9}', "UNVERIFIABLE", "INVALID_VERDICT"),
    ("rationale", '{"verdict":"SUPPORTS","cited_paragraph_ids":["p1"],"rationale":" ","confidence":0.9}', "UNVERIFIABLE", "INVALID_RATIONALE"),
    ("boolean", '{"verdict":"SUPPORTS","cited_paragraph_ids":["p1"],"rationale":"r","confidence":true}', "UNVERIFIABLE", "INVALID_CONFIDENCE"),
    ("range", '{"verdict":"SUPPORTS","cited_paragraph_ids":["p1"],"rationale":"r","confidence":1.5}', "UNVERIFIABLE", "INVALID_CONFIDENCE"),
    ("repeated ids", '{"verdict":"SUPPORTS","cited_paragraph_ids":["p1","p1"],"rationale":"r","confidence":0.9}', "UNVERIFIABLE", "INVALID_CITED_PARAGRAPH_IDS"),
    ("no ids", '{"verdict":"PARTIAL","cited_paragraph_ids":[],"rationale":"r","confidence":0.9}', "UNVERIFIABLE", "MISSING_EVIDENCE"),
    ("foreign id", '{"verdict":"PARTIAL","cited_paragraph_ids":["x"],"rationale":"r","confidence":0.9}', "UNVERIFIABLE", "INVALID_EVIDENCE_ID"),
    ("low", '{"verdict":"PARTIAL","cited_paragraph_ids":["p1"],"rationale":"r","confidence":0.599}', "UNVERIFIABLE", "LOW_CONFIDENCE"),
    ("contradicts low", '{"verdict":"CONTRADICTS","cited_paragraph_ids":["p1"],"rationale":"r","confidence":0.749}', "UNVERIFIABLE", "CONTRADICTS_CONFIDENCE_TOO_LOW"),
    ("contradicts", '{"verdict":"CONTRADICTS","cited_paragraph_ids":["p1"],"rationale":"r","confidence":0.75}', "CONTRADICTS", None),
)


@query(dealt_sql("events", "event_id", [(a[0], *a[2:]) for a in ANSWERS], '"case", verdict, reason'))
def proposition_validator(spark: SparkSession, d: str) -> DataFrame:
    """A judge's answer against the evidence that it was given; the first rule broken is the reason."""
    rows = dealt(spark, d, "events", "event_id", [(a[0], a[1].replace('"r"', '"r {k}"')) for a in ANSWERS], "case string, answer string")
    parts = F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])
    return validated(rows.withColumn("parts", parts), ["k", "case"])


# fixed value: longest rationale
RATIONALE = 300
#: Least confidence, and that of a contradiction.
CONFIDENCE, CONTRADICTION = settings().confidence, settings().contradiction


def validated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict, reason) of a judge's answers: rows (keys, answer, parts), answer as JSON, parts a map of the evidence's ids to opinion parts.

    The first rule broken is the reason, and the verdict then UNVERIFIABLE. Support by dissents and concurrences alone is PARTIAL. Null answers and
    such as aren't JSON are INVALID_JUDGE_OUTPUT; with null or empty parts no id is known.
    """
    v = F.try_parse_json("answer")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    item_kinds = F.transform(get("$.cited_paragraph_ids", "array<variant>"), lambda x: F.schema_of_variant(x))
    rows = rows.select(
        *keys, F.schema_of_variant(v).startswith("OBJECT").alias("object"), get("$.verdict", "string").alias("said"), kind("$.rationale").alias("r_kind"),
        get("$.rationale", "string").alias("rationale"), kind("$.confidence").alias("c_kind"), get("$.confidence", "double").alias("confidence"),
        kind("$.cited_paragraph_ids").alias("i_kind"), get("$.cited_paragraph_ids", "array<string>").alias("ids"), item_kinds.alias("kinds"),
        F.coalesce("parts", F.create_map().cast("map<string,string>")).alias("parts"),
    )
    ids, said, c, part = F.col("ids"), F.col("said"), F.col("confidence"), F.col("parts")
    no = lambda condition: F.coalesce(condition, F.lit(True))
    foreign = F.exists("kinds", lambda k: k != "STRING")
    reason = (
        F.when(no(~F.col("object")), "INVALID_JUDGE_OUTPUT")
        .when(no(~said.isin("SUPPORTS", "PARTIAL", "CONTRADICTS", "NOT_ADDRESSED")), "INVALID_VERDICT")
        .when(no((F.col("r_kind") != "STRING") | (F.trim("rationale") == "") | (F.length("rationale") > RATIONALE)), "INVALID_RATIONALE")
        .when(no((F.col("c_kind") == "BOOLEAN") | F.col("c_kind").isin("STRING", "VOID") | ~c.between(0, 1)), "INVALID_CONFIDENCE")
        .when(no(~F.col("i_kind").startswith("ARRAY") | foreign | F.exists(ids, lambda x: x.isNull() | (x == "")) | (F.size(F.array_distinct(ids)) < F.size(ids))), "INVALID_CITED_PARAGRAPH_IDS")
        .when((said != "NOT_ADDRESSED") & (F.size(ids) == 0), "MISSING_EVIDENCE")
        .when(F.exists(ids, lambda x: ~F.map_contains_key(part, x)), "INVALID_EVIDENCE_ID")
        .when(c < CONFIDENCE, "LOW_CONFIDENCE")
        .when((said == "CONTRADICTS") & (c < CONTRADICTION), "CONTRADICTS_CONFIDENCE_TOO_LOW")
    )
    minor = (said == "SUPPORTS") & (F.size(ids) > 0) & F.forall(ids, lambda x: F.coalesce(part[x].isin("dissent", "concurrence"), F.lit(False)))
    verdict = F.when(reason.isNotNull(), "UNVERIFIABLE").when(minor, "PARTIAL").otherwise(said)
    return rows.select(*keys, verdict.alias("verdict"), reason.alias("reason"))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of rows (check, positive, predicted, abstained): an abstained positive is missed, and isn't scored."""
    p, a, q = F.col("positive"), F.col("abstained"), F.col("predicted")
    return rows.groupBy("check").agg(
        F.count_if(p & q & ~a).alias("tp"), F.count_if(~p & q & ~a).alias("fp"), F.count_if(p & (a | ~q)).alias("fn"), F.count_if(~p & ~q & ~a).alias("tn"),
        F.count_if(a).alias("abstained"), F.count_if(~a).alias("scored"), F.count("*").alias("labelled"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Precision and recall; null where there is nothing to divide by."""
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 4)
    return counts.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


EVAL_SQL = """o AS (SELECT l.doc_id, l.quality = 0 AS positive, d.source AS "check", d.n_chars % 11 = 0 AS abstained, d.text LIKE '%|%' OR d.text LIKE '%$$$%' AS predicted
  FROM labels l JOIN documents d USING (doc_id)),
  k AS (SELECT "check", count(*) FILTER (WHERE positive AND predicted AND NOT abstained) AS tp, count(*) FILTER (WHERE NOT positive AND predicted AND NOT abstained) AS fp,
  count(*) FILTER (WHERE positive AND (abstained OR NOT predicted)) AS fn, count(*) FILTER (WHERE NOT positive AND NOT predicted AND NOT abstained) AS tn,
  count(*) FILTER (WHERE abstained) AS abstained, count(*) FILTER (WHERE NOT abstained) AS scored, count(*) AS labelled FROM o GROUP BY "check")"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(
        "doc_id", F.col("source").alias("check"), (F.col("n_chars") % 11 == 0).alias("abstained"), (F.col("text").contains("|") | F.col("text").contains("$$$")).alias("predicted")
    )
    return read(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("positive")).join(docs, "doc_id")


@query(f"WITH {EVAL_SQL} SELECT * FROM k")
def eval_confusion(spark: SparkSession, d: str) -> DataFrame:
    return confusion(observations(spark, d))


@query(f'WITH {EVAL_SQL} SELECT "check", round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM k')
def eval_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return rates(confusion(observations(spark, d))).select("check", "precision", "recall")


@query("""SELECT o_custkey AS "check", round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS tp,
    count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS fp, count(*) FILTER (WHERE o_orderstatus = 'P') AS fn FROM orders GROUP BY 1)""")
def eval_metrics_from_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rates of counts of true and false positives and false negatives; null without any."""
    status = F.col("o_orderstatus")
    counts = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("check")).agg(
        F.count_if(status == "F").alias("tp"), F.count_if((status == "O") & (F.col("o_orderkey") % 2 == 0)).alias("fp"), F.count_if(status == "P").alias("fn")
    )
    return rates(counts).select("check", "precision", "recall")
