"""The fix list of a document: its items in their order, the findings of each by time, and under each the language that is nearest and where it comes from.

Every line is a row with the place of its parts (item, finding, line) as a sort key; a range-partitioned sort of all lines of all documents gives each its number, so
neither a document nor its lines come to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.functions.verdict_terms import LABEL_SQL, is_issue, label
from sparkquill.operators.queues import placed
from sparkquill.sources.tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# fixed values: lines of the report
TITLE, ITEMS, NOTHING = "# Fix list", "## Items to review", "No items requiring review were found in the completed checks."
NOTE, NOTE_TEXT = "## Provenance note", "Source links and retrieval metadata below identify the material that was reviewed."
DISCLAIMER = "Differences between a document and the sources it cites are reported here. This is not legal advice. Always review the linked source text yourself."


def lines_of(rows: DataFrame, part: int, lines, page=None, start=None, item=None, created=None, finding=None) -> DataFrame:
    """(g, o): a row for each line of an array, with its sort key; null lines are left out, and numbers keep their order."""
    given = lambda c, kind, none: F.lit(none).cast(kind) if c is None else F.col(c).cast(kind)
    head = [
        F.lit(part).alias("part"), given(page, "int", None).isNull().alias("unpaged"), F.coalesce(given(page, "int", None), F.lit(0)).alias("page"),
        F.coalesce(given(start, "int", None), F.lit(0)).alias("start"), given(item, "string", "").alias("item"), F.lit(created is not None).alias("found"),
        given(created, "string", "").alias("created"), given(finding, "string", "").alias("finding"),
    ]
    each = rows.select(F.col("job").alias("g"), *head, F.posexplode(lines).alias("n", "line")).where("line is not null")
    return each.select("g", F.struct("part", "unpaged", "page", "start", "item", "found", "created", "finding", "n", "line").alias("o"))


def language(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """findings with `language`: the nearest actual language if a finding has it, else its passages (finding, pos, text) in order if the item has a source."""
    passages = evidence.where(F.coalesce("text", F.lit("")) != "").groupBy("finding").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["text"]), " / ")
    out = findings.join(passages, "finding", "left")
    return out.withColumn("language", F.coalesce("closest", F.when(F.col("method").isNotNull(), joined))).drop("p")


def fix_list(jobs: DataFrame, items: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(job, line_no, line) for each of jobs (job, name).

    items: (job, item, raw_text, page, start, quote_text, proposition_text, link, method, retrieved, sha256), null method where there is no source. findings:
    (item, finding, check, verdict, created, closest). evidence: (finding, pos, text). Items come by page, those without one last, then by start and id as text; findings
    by time and id as text. Positive verdicts aren't listed, items without others neither. A job without any says so.
    """
    wanted = findings.where(is_issue(F.col("verdict"))).join(items, "item").join(jobs.select("job"), "job", "left_semi")
    wanted = language(wanted, evidence)
    brief = F.when((F.col("check") == "quote") & (F.coalesce("quote_text", F.lit("")) != ""), F.col("quote_text")).when((F.col("check") == "proposition") & (F.coalesce("proposition_text", F.lit("")) != ""), F.col("proposition_text")).otherwise(F.col("raw_text"))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    found = F.array(
        F.concat(F.lit("- **"), T.redact(F.col("check")), F.lit(" — "), label(F.coalesce("verdict", F.lit(""))), F.lit(".**")),
        F.when(filled(brief), F.concat(F.lit("  - Brief text: “"), T.redact(brief), F.lit("”"))),
        F.when(filled(F.col("language")), F.concat(F.lit("  - Source language reviewed: “"), T.redact(F.col("language")), F.lit("”"))),
        F.when(filled(F.col("link")), F.concat(F.lit("  - Source: "), F.col("link"))),
        F.when(F.col("method").isNotNull(), F.concat(F.lit("  - Provenance: method="), F.col("method"), F.lit("; retrieved="), F.coalesce("retrieved", F.lit("unknown time")), F.lit("; sha256="), F.col("sha256"))),
    )
    body = lines_of(wanted.withColumn("when", F.date_format("created", "yyyy-MM-dd HH:mm:ss.SSSSSS")), 1, found, "page", "start", "item", "when", "finding")
    shown = items.join(wanted.select("item").distinct(), "item", "left_semi")
    heads = lines_of(shown, 1, F.array(F.concat(F.lit("### "), T.redact(F.col("raw_text"))), F.lit(""), F.concat(F.lit("Brief page: "), F.coalesce(F.col("page").cast("string"), F.lit("not available")))), "page", "start", "item")
    ends = lines_of(shown.withColumn("last", F.lit("~")), 1, F.array(F.lit("")), "page", "start", "item", "last", "last")
    top = lines_of(jobs, 0, F.array(F.lit(TITLE), F.lit(""), F.concat(F.lit("Document: "), T.redact(F.col("name"))), F.lit(""), F.lit("> " + DISCLAIMER), F.lit(""), F.lit(ITEMS), F.lit("")))
    none = lines_of(jobs.join(shown.select("job").distinct(), "job", "left_anti"), 1, F.array(F.lit(NOTHING), F.lit("")))
    foot = lines_of(jobs, 2, F.array(F.lit(""), F.lit(NOTE), F.lit(""), F.lit(NOTE_TEXT)))
    every = body.unionByName(heads).unionByName(ends).unionByName(top).unionByName(none).unionByName(foot).withColumn("s", F.lit(0).cast("bigint"))
    return placed(every).select(F.col("g").alias("job"), (F.col("at") + 1).alias("line_no"), F.col("o.line").alias("line"))


# fixed values: verdict of each order status
VERDICT_OF_STATUS = {"F": "VERBATIM", "O": "ALTERED", "P": "NOT_FOUND_IN_SOURCE"}


@query(
    f"""WITH j AS (SELECT n_nationkey AS job, n_name AS name FROM nation),
    i AS (SELECT c_nationkey AS job, c_custkey AS item, c_name AS raw_text, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 9 END AS page, c_custkey % 97 AS start,
      CASE WHEN c_custkey % 3 <> 0 THEN 'https://example.org/' || c_custkey END AS link, CASE WHEN c_custkey % 3 <> 0 THEN 'lookup' END AS method, sha256(c_name) AS sha FROM customer),
    e AS (SELECT l_orderkey AS finding, string_agg(l_returnflag || l_linestatus || l_linenumber, ' / ' ORDER BY l_linenumber, l_returnflag || l_linestatus || l_linenumber) AS t FROM lineitem GROUP BY 1),
    f AS (SELECT i.*, o_orderkey AS finding, ['existence', 'quote', 'proposition'][o_orderkey % 3 + 1] AS "check", CASE o_orderstatus WHEN 'F' THEN 'VERBATIM' WHEN 'O' THEN 'ALTERED' ELSE 'NOT_FOUND_IN_SOURCE' END AS verdict,
      o_orderdate AS created, CASE WHEN o_orderkey % 4 = 0 THEN 'closest ' || o_orderkey WHEN method IS NOT NULL THEN t END AS language FROM orders JOIN i ON o_custkey = item LEFT JOIN e ON finding = o_orderkey),
    w AS (SELECT *, {LABEL_SQL} AS label, CASE WHEN "check" = 'quote' AND item % 2 = 0 THEN 'Q' || item WHEN "check" = 'proposition' AND item % 2 = 1 THEN 'P' || item ELSE raw_text END AS brief FROM f WHERE verdict <> 'VERBATIM'),
    s AS (SELECT DISTINCT job, item, raw_text, page, start FROM w),
    b AS (SELECT job, 1 AS part, page, start, item, 1 AS found, created, finding, unnest([1, 2, 3, 4, 5]) AS n, unnest(['- **' || "check" || ' — ' || label || '.**', '  - Brief text: “' || brief || '”',
        '  - Source language reviewed: “' || language || '”', '  - Source: ' || link, '  - Provenance: method=' || method || '; retrieved=unknown time; sha256=' || sha]) AS line FROM w
      UNION ALL SELECT job, 1, page, start, item, 0, NULL, NULL, unnest([1, 2, 3]), unnest(['### ' || raw_text, '', 'Brief page: ' || coalesce(page::VARCHAR, 'not available')]) FROM s
      UNION ALL SELECT job, 1, page, start, item, 2, NULL, NULL, 1, '' FROM s
      UNION ALL SELECT job, 0, NULL, 0, NULL, 0, NULL, NULL, unnest(range(8)), unnest(['{TITLE}', '', 'Document: ' || name, '', '> {DISCLAIMER}', '', '{ITEMS}', '']) FROM j
      UNION ALL SELECT job, 1, NULL, 0, NULL, 0, NULL, NULL, unnest([1, 2]), unnest(['{NOTHING}', '']) FROM j WHERE job NOT IN (SELECT job FROM s)
      UNION ALL SELECT job, 2, NULL, 0, NULL, 0, NULL, NULL, unnest(range(4)), unnest(['', '{NOTE}', '', '{NOTE_TEXT}']) FROM j)
    SELECT job, row_number() OVER (PARTITION BY job ORDER BY part, page IS NULL, page, start, item::VARCHAR, found, created, finding::VARCHAR, n) AS line_no, line FROM b WHERE line IS NOT NULL"""
)
def fix_list_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fix lists of all nations as documents, customers as items and orders as findings."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    jobs = read(spark, d, "nation").select(F.col("n_nationkey").alias("job"), F.col("n_name").alias("name"))
    sourced = lambda x: F.when(c % 3 != 0, x)
    items = read(spark, d, "customer").select(
        F.col("c_nationkey").alias("job"), c.alias("item"), F.col("c_name").alias("raw_text"), F.when(c % 5 != 0, c % 9).alias("page"), (c % 97).alias("start"),
        F.when(c % 2 == 0, F.concat(F.lit("Q"), c)).alias("quote_text"), F.when(c % 2 == 1, F.concat(F.lit("P"), c)).alias("proposition_text"), sourced(F.concat(F.lit("https://example.org/"), c)).alias("link"),
        sourced(F.lit("lookup")).alias("method"), F.lit(None).cast("string").alias("retrieved"), F.sha2("c_name", 256).alias("sha256"),
    )
    status = F.create_map(*[F.lit(x) for pair in VERDICT_OF_STATUS.items() for x in pair])
    found = read(spark, d, "orders").select(
        F.col("o_custkey").alias("item"), o.alias("finding"), F.element_at(F.array(F.lit("existence"), F.lit("quote"), F.lit("proposition")), (o % 3 + 1).cast("int")).alias("check"), status[F.col("o_orderstatus")].alias("verdict"),
        F.col("o_orderdate").alias("created"), F.when(o % 4 == 0, F.concat(F.lit("closest "), o)).alias("closest"),
    )
    evidence = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("finding"), F.col("l_linenumber").alias("pos"), F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("text"))
    return fix_list(jobs, items, found, evidence)
