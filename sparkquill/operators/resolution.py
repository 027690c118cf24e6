"""What a citation's existence comes to in the end: through its antecedent, the lookup, and the investigation of what the lookup couldn't settle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.operators.candidates import closing_rows
from sparkquill.operators.verdicts import existence
from sparkquill.sources.tables import read, stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def resolved(citations: DataFrame, lookups: DataFrame, clusters: DataFrame, investigations: DataFrame) -> DataFrame:
    """(citation_id, check, verdict, note, source) of citations (citation_id, cite, case_name, year, state, antecedent_id, quote).

    A citation stands for its antecedent. One that is unresolved, or whose antecedent isn't there, is UNVERIFIABLE, and its other checks are closed by the same
    note. What the lookup leaves PENDING is what the investigation (citation_id, verdict, source, error) says: a source verifies it, an error proves nothing, and a verdict
    stands with a note; without an investigation it stays PENDING. Keys of lookups and clusters are `cite`. Repeated investigations of a citation count as one, that with a source first.
    """
    own = citations.select(F.col("citation_id").alias("target_id"), F.struct("cite", "case_name", "year").alias("target"))
    rows = citations.withColumn("target_id", F.coalesce("antecedent_id", "citation_id")).join(own, "target_id", "left")
    broken = F.coalesce(F.col("state") == "unresolved", F.lit(False)) | F.col("target").isNull()
    rows = stored(rows.withColumn("broken", broken), "targets")
    asked = rows.where(~F.col("broken")).select("target.*").groupBy("cite").agg(F.min(F.struct("case_name", "year")).alias("t")).select("cite", "t.*")
    told = existence(asked, lookups, clusters).select(F.col("cite").alias("target_cite"), F.col("verdict").alias("by_lookup"), F.col("id").cast("string").alias("cluster"))
    found = investigations.groupBy("citation_id").agg(F.min_by(F.struct("verdict", "source", "error"), F.struct(F.col("source").isNull(), F.col("error").isNotNull(), "verdict")).alias("i"))
    met = rows.join(told, F.col("target.cite") == F.col("target_cite"), "left").join(found, "citation_id", "left")
    searched = (F.col("by_lookup") == "PENDING") & F.col("i").isNotNull()
    verdict = (
        F.when(F.col("broken"), "UNVERIFIABLE").when(~F.coalesce(searched, F.lit(False)), F.col("by_lookup")).when(F.col("i.source").isNotNull(), "VERIFIED_OFFICIAL")
        .when(F.col("i.error").isNotNull() | F.col("i.verdict").isNull(), "UNVERIFIABLE").otherwise(F.col("i.verdict"))
    )
    note = F.when(F.col("broken"), "UNRESOLVED_REFERENCE").when(
        F.coalesce(searched, F.lit(False)) & F.col("i.source").isNull(), F.when(F.col("i.error").isNotNull() | F.col("i.verdict").isNull(), "INVESTIGATOR_UNAVAILABLE").otherwise("INVESTIGATION_COMPLETED")
    )
    source = F.when(F.col("broken"), F.lit(None)).when(F.coalesce(searched, F.lit(False)), F.col("i.source")).otherwise(F.col("cluster"))
    said = met.select("citation_id", F.lit("existence").alias("check"), verdict.alias("verdict"), note.alias("note"), source.alias("source"))
    closed = closing_rows(rows.where("broken").select("citation_id", "quote", F.lit("UNRESOLVED_REFERENCE").alias("reason")))
    return said.unionByName(closed.withColumn("source", F.lit(None).cast("string")))


@query(
    """WITH c AS (SELECT o_orderkey AS citation_id, o_orderkey // 2 AS cite, 'Case v. ' || (o_orderkey // 2 % 50) AS name, 1992 + o_orderkey // 2 % 7 AS y, CASE WHEN o_orderkey % 31 = 0 THEN 'unresolved' END AS state,
      CASE WHEN o_orderkey % 29 = 0 THEN -o_orderkey - 1 WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 END AS antecedent_id, CASE WHEN o_orderkey % 3 = 0 THEN 'q' END AS quote FROM orders),
    r AS (SELECT c.*, t.cite AS t_cite, t.name AS t_name, t.y AS t_y, coalesce(c.state = 'unresolved', false) OR t.cite IS NULL AS broken FROM c LEFT JOIN c t ON t.citation_id = coalesce(c.antecedent_id, c.citation_id)),
    l AS (SELECT l_orderkey AS cite, l_linenumber AS id, 'CASE V ' || (l_suppkey % 50) AS name, year(l_shipdate) AS y FROM lineitem),
    n AS (SELECT cite, CASE WHEN cite % 11 = 0 THEN 404 WHEN cite % 13 = 0 THEN 503 WHEN count(*) = 1 THEN 200 ELSE 300 END AS status, min(id) AS one_id FROM l GROUP BY cite),
    a AS (SELECT DISTINCT t_cite AS cite, t_name AS name, t_y AS y FROM r WHERE NOT broken),
    f AS (SELECT a.cite, min(l.id) AS id FROM a JOIN l ON l.cite = a.cite AND lower(replace(a.name, 'v.', 'v')) = lower(l.name) AND a.y = l.y GROUP BY a.cite HAVING count(*) = 1),
    e AS (SELECT a.cite, CASE WHEN status = 200 OR status = 300 AND id IS NOT NULL THEN 'VERIFIED' WHEN status IN (300, 404) THEN 'PENDING' ELSE 'UNVERIFIABLE' END AS verdict,
      CASE WHEN status = 200 THEN one_id WHEN status = 300 THEN id END AS cluster FROM a LEFT JOIN n USING (cite) LEFT JOIN f USING (cite)),
    m AS (SELECT r.citation_id, r.quote, broken, verdict, cluster, citation_id % 5 AS i, verdict = 'PENDING' AND citation_id % 5 < 4 AS searched FROM r LEFT JOIN e ON e.cite = t_cite)
    SELECT citation_id, 'existence' AS "check", CASE WHEN broken THEN 'UNVERIFIABLE' WHEN searched IS NOT TRUE THEN verdict WHEN i = 0 THEN 'VERIFIED_OFFICIAL' WHEN i = 1 THEN 'UNVERIFIABLE' WHEN i = 2 THEN 'WEAKLY_CORROBORATED' ELSE 'NOT_FOUND_ANYWHERE' END AS verdict,
      CASE WHEN broken THEN 'UNRESOLVED_REFERENCE' WHEN searched AND i = 1 THEN 'INVESTIGATOR_UNAVAILABLE' WHEN searched AND i > 1 THEN 'INVESTIGATION_COMPLETED' END AS note,
      CASE WHEN broken THEN NULL WHEN searched IS NOT TRUE THEN cluster::VARCHAR WHEN i = 0 THEN 's' || citation_id END AS source FROM m
    UNION ALL SELECT citation_id, 'quote', 'SOURCE_UNAVAILABLE', NULL, NULL FROM m WHERE broken AND quote IS NOT NULL UNION ALL SELECT citation_id, 'proposition', 'UNVERIFIABLE', 'UNRESOLVED_REFERENCE', NULL FROM m WHERE broken"""
)
def citation_existence(spark: SparkSession, d: str) -> DataFrame:
    """Orders as citations, two of a source, some of them short forms of the next one or of none; what is pending was investigated, but for a fifth."""
    k = F.col("o_orderkey")
    cite = F.floor(k / 2)
    cites = read(spark, d, "orders").select(
        k.alias("citation_id"), cite.alias("cite"), F.concat(F.lit("Case v. "), cite % 50).alias("case_name"), (1992 + cite % 7).cast("int").alias("year"), F.when(k % 31 == 0, "unresolved").alias("state"),
        F.when(k % 29 == 0, -k - 1).when(k % 4 == 0, k + 1).alias("antecedent_id"), F.when(k % 3 == 0, "q").alias("quote"),
    )
    clusters = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("cite"), F.col("l_linenumber").alias("id"), F.concat(F.lit("CASE V "), F.col("l_suppkey") % 50).alias("name"),
        F.lit(None).cast("string").alias("name_full"), F.col("l_shipdate").cast("date").cast("string").alias("day"),
    )
    c = F.col("cite")
    status = F.when(c % 11 == 0, 404).when(c % 13 == 0, 503).when(F.col("n") == 1, 200).otherwise(300)
    lookups = clusters.groupBy("cite").agg(F.count("*").alias("n")).select("cite", status.alias("status"))
    i = k % 5
    told = read(spark, d, "orders").where(i < 4).select(
        k.alias("citation_id"), F.when(i == 2, "WEAKLY_CORROBORATED").when(i == 3, "NOT_FOUND_ANYWHERE").alias("verdict"), F.when(i == 0, F.concat(F.lit("s"), k)).alias("source"), F.when(i == 1, "timeout").alias("error")
    )
    return resolved(cites, lookups, clusters, told)
