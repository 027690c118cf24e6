"""Evaluation of findings against answer keys: labels met by containment, first verdicts, counts by check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.functions.text import match_key
from sparkquill.operators.verdicts import confusion, rates
from sparkquill.sources.tables import read

QUERIES, SQL = {}, {}
# fixed values: verdicts of a check that tell an issue (of existence: those that tell none), verdicts that abstain, and the use that is an issue
SOUND = ("VERIFIED", "VERIFIED_OFFICIAL")
ISSUES = {"quote": ("ALTERED", "PARAPHRASE_IN_QUOTES", "NOT_FOUND_IN_SOURCE"), "proposition": ("PARTIAL", "CONTRADICTS", "NOT_ADDRESSED")}
ABSTAINED, MISUSED = ("UNVERIFIABLE", "SOURCE_UNAVAILABLE", "PENDING"), "MISREPRESENTED"
#: Characters of a label's key that it meets citations by, and labels of a brief that each of its citations is held against as they are.
GRAM, FEW = 6, 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def met_labels(labels: DataFrame, observations: DataFrame) -> DataFrame:
    """(brief, nth, place): labels (brief, nth, citation) whose key is held by the key of a citation (brief, place, normalized, raw_text) of their brief.

    A key is the text in small letters without white space. A brief's FEW labels or less come to each of its citations as a list. Of briefs with more, the
    last GRAM characters of a label's key are one of the grams of each key that holds it, so labels and citations of a brief meet by an equi-join on the gram,
    and only then is containment checked. Keys that are shorter meet all citations of their brief; empty ones meet none.
    """
    asked = labels.select("brief", "nth", match_key(F.col("citation")).alias("key")).where("key <> ''")
    keys = F.array_distinct(F.array_compact(F.array(match_key(F.col("normalized")), match_key(F.col("raw_text")))))
    every = observations.select("brief", "place", keys.alias("keys"))
    many = asked.groupBy("brief").count().where(F.col("count") > FEW).select("brief")
    lists = asked.join(many, "brief", "left_anti").groupBy("brief").agg(F.collect_list(F.struct("nth", "key")).alias("few"))
    holding = F.filter("few", lambda x: F.exists("keys", lambda k: k.contains(x["key"])))
    by_list = every.join(lists, "brief").select("brief", F.explode(holding["nth"]).alias("nth"), "place").distinct()
    asked, every = asked.join(many, "brief", "left_semi"), every.join(many, "brief", "left_semi")
    held = every.select("brief", "place", F.explode("keys").alias("held"))

    def grams(c: Column) -> Column:
        all_of = F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.substring(c, i, F.lit(GRAM)))
        return F.array_distinct(F.when(F.length(c) >= GRAM, all_of).otherwise(F.array().cast("array<string>")))

    long = asked.where(F.length("key") >= GRAM).withColumn("gram", F.right("key", F.lit(GRAM)))
    near = long.join(held.select("brief", "place", "held", F.explode(grams(F.col("held"))).alias("gram")), ["brief", "gram"]).drop("gram")
    near = near.unionByName(asked.where(F.length("key") < GRAM).join(held, "brief"))
    return by_list.unionByName(near.where(F.col("held").contains(F.col("key"))).select("brief", "nth", "place").distinct())


def first_verdicts(met: DataFrame, findings: DataFrame) -> DataFrame:
    """(brief, nth, check, verdict): of findings (brief, place, pos, check, verdict) the first of each label and check, by place and position, of equal ones the lesser verdict."""
    rows = met.join(findings.where(F.col("verdict").isNotNull()), ["brief", "place"])
    return rows.groupBy("brief", "nth", "check").agg(F.min(F.struct("place", "pos", "verdict"))["verdict"].alias("verdict"))


def judged(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(check, positive, predicted, abstained, exact) of labels (brief, nth, existence, use) and first verdicts.

    A label that expects an existence is one row of that check; one that tells a use is a row of both others. Without a verdict, and with one that
    abstains, a row is abstained.
    """
    wanted = F.array(
        F.when(F.col("existence").isNotNull(), F.struct(F.lit("existence").alias("check"), (~F.col("existence").isin(*SOUND)).alias("positive"))),
        *[F.when(F.col("use").isNotNull(), F.struct(F.lit(c).alias("check"), (F.col("use") == MISUSED).alias("positive"))) for c in ISSUES],
    )
    rows = labels.select("brief", "nth", "existence", F.explode(F.array_compact(wanted)).alias("w")).select("brief", "nth", "existence", "w.*")
    rows = rows.join(verdicts, ["brief", "nth", "check"], "left")
    v, check = F.col("verdict"), F.col("check")
    issue = F.when(check == "existence", ~v.isin(*SOUND))
    for name, bad in ISSUES.items():
        issue = issue.when(check == name, v.isin(*bad))
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "check", "positive", no(issue).alias("predicted"), (v.isNull() | no(v.isin(*ABSTAINED))).alias("abstained"), no((check == "existence") & (v == F.col("existence"))).alias("exact")
    )


def without_jobs(labels: DataFrame, jobs: DataFrame) -> DataFrame:
    """Briefs of labels that no job (brief, job) is known for: an evaluation can't start while there are any."""
    return labels.select("brief").distinct().join(jobs.where(F.col("job").isNotNull()), "brief", "left_anti")


def evaluate(labels: DataFrame, observations: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts, precision and recall by check; existence has its exact matches too."""
    rows = judged(labels, first_verdicts(met_labels(labels, observations), findings))
    exact = rows.groupBy("check").agg(F.count_if(F.col("exact")).alias("exact"))
    return rates(confusion(rows)).join(exact, "check")


def dataset(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_distinct("brief").alias("briefs"), F.count("*").alias("labelled"))


# -- queries --------------------------------------------------------------------------------------------------------

KEYS_SQL = """l AS (SELECT o_custkey AS brief, o_orderkey AS nth, o_orderkey || ' U.S. ' || o_custkey AS citation,
    CASE WHEN o_orderstatus = 'F' THEN 'VERIFIED' WHEN o_orderstatus = 'O' THEN 'NOT_FOUND_ANYWHERE' END AS existence,
    CASE WHEN o_orderkey % 3 = 0 THEN 'MISREPRESENTED' WHEN o_orderkey % 3 = 1 THEN 'ACCURATE' END AS use FROM orders),
  o AS (SELECT o_custkey AS brief, o_orderkey AS place, CASE WHEN o_orderkey % 2 = 0 THEN lower('Roe v. Wade, ' || o_orderkey || ' U.S. ' || o_custkey || ', 12') END AS normalized,
    CASE WHEN o_orderkey % 5 > 0 THEN 'Roe,' || chr(10) || o_orderkey || '  U.S. ' || o_custkey END AS raw_text FROM orders),
  f AS (SELECT o_custkey AS brief, l_orderkey AS place, l_linenumber AS pos, ['existence', 'quote', 'proposition'][l_linenumber % 3 + 1] AS "check",
    CASE WHEN l_linenumber % 3 = 0 THEN CASE l_returnflag WHEN 'A' THEN 'VERIFIED' WHEN 'N' THEN 'NOT_FOUND_ANYWHERE' ELSE 'PENDING' END
    WHEN l_linenumber % 3 = 1 THEN CASE l_returnflag WHEN 'A' THEN 'VERBATIM' WHEN 'N' THEN 'ALTERED' END
    ELSE CASE l_returnflag WHEN 'A' THEN 'SUPPORTS' WHEN 'N' THEN 'PARTIAL' ELSE 'UNVERIFIABLE' END END AS verdict FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  m AS (SELECT l.brief, nth, place FROM l JOIN o ON o.brief = l.brief AND (contains(lower(regexp_replace(normalized, '\\s+', '', 'g')), lower(replace(citation, ' ', '')))
    OR contains(lower(regexp_replace(raw_text, '\\s+', '', 'g')), lower(replace(citation, ' ', ''))))),
  v AS (SELECT m.brief, nth, "check", min(struct_pack(p := m.place, n := pos, v := verdict)).v AS verdict FROM m JOIN f ON f.brief = m.brief AND f.place = m.place WHERE verdict IS NOT NULL GROUP BY ALL)"""


def answer_keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as labels and citations, their line items as findings; a customer is a brief."""
    k, c, orders = F.col("o_orderkey"), F.col("o_custkey"), read(spark, d, "orders")
    cite = F.concat(k, F.lit(" U.S. "), c)
    existence = F.when(F.col("o_orderstatus") == "F", "VERIFIED").when(F.col("o_orderstatus") == "O", "NOT_FOUND_ANYWHERE")
    labels = orders.select(c.alias("brief"), k.alias("nth"), cite.alias("citation"), existence.alias("existence"), F.when(k % 3 == 0, MISUSED).when(k % 3 == 1, "ACCURATE").alias("use"))
    normalized = F.when(k % 2 == 0, F.lower(F.concat(F.lit("Roe v. Wade, "), cite, F.lit(", 12"))))
    observations = orders.select(c.alias("brief"), k.alias("place"), normalized.alias("normalized"), F.when(k % 5 > 0, F.concat(F.lit("Roe,\n"), k, F.lit("  U.S. "), c)).alias("raw_text"))
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    verdict = (
        F.when(n % 3 == 0, F.when(flag == "A", "VERIFIED").when(flag == "N", "NOT_FOUND_ANYWHERE").otherwise("PENDING"))
        .when(n % 3 == 1, F.when(flag == "A", "VERBATIM").when(flag == "N", "ALTERED"))
        .otherwise(F.when(flag == "A", "SUPPORTS").when(flag == "N", "PARTIAL").otherwise("UNVERIFIABLE"))
    )
    check = F.get(F.array(*map(F.lit, ("existence", "quote", "proposition"))), n % 3)
    found = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("place"), n.alias("pos"), check.alias("check"), verdict.alias("verdict"))
    return labels, observations, found.join(observations.select("brief", "place"), "place")


@query(
    f"""WITH {KEYS_SQL}, w AS (SELECT brief, nth, existence, 'existence' AS "check", existence <> 'VERIFIED' AS positive FROM l WHERE existence IS NOT NULL
    UNION ALL SELECT brief, nth, existence, unnest(['quote', 'proposition']), use = 'MISREPRESENTED' FROM l WHERE use IS NOT NULL),
    j AS (SELECT w.*, verdict, verdict IS NULL OR verdict IN ('UNVERIFIABLE', 'PENDING') AS abstained, coalesce(verdict IN ('NOT_FOUND_ANYWHERE', 'PENDING', 'ALTERED', 'PARTIAL'), false) AS predicted FROM w LEFT JOIN v USING (brief, nth, "check")),
    k AS (SELECT "check", count(*) FILTER (WHERE positive AND predicted AND NOT abstained) AS tp, count(*) FILTER (WHERE NOT positive AND predicted AND NOT abstained) AS fp,
      count(*) FILTER (WHERE positive AND (abstained OR NOT predicted)) AS fn, count(*) FILTER (WHERE NOT positive AND NOT predicted AND NOT abstained) AS tn,
      count(*) FILTER (WHERE abstained) AS abstained, count(*) FILTER (WHERE NOT abstained) AS scored, count(*) AS labelled,
      count(*) FILTER (WHERE "check" = 'existence' AND verdict = existence) AS exact FROM j GROUP BY "check")
    SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM k"""
)
def eval_answer_keys(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(*answer_keys(spark, d))


@query(f"WITH {KEYS_SQL} SELECT brief, nth, place FROM m")
def eval_contains_match(spark: SparkSession, d: str) -> DataFrame:
    labels, observations, _ = answer_keys(spark, d)
    return met_labels(labels, observations)


@query("SELECT count(DISTINCT o_custkey) AS briefs, count(*) AS labelled FROM orders")
def eval_dataset(spark: SparkSession, d: str) -> DataFrame:
    return dataset(answer_keys(spark, d)[0])


@query("SELECT DISTINCT o_custkey AS brief FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)")
def eval_without_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = read(spark, d, "customer").select(F.col("c_custkey").alias("brief"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("job"))
    return without_jobs(answer_keys(spark, d)[0], jobs)
