"""Findings: summaries, completeness, upserts, states, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.functions.verdict_terms import LABEL_SQL, RANK_SQL, TONE_SQL, TONES, is_issue, label, tone, tone_rank
from sparkquill.sources.tables import EACH, FINDINGS_SQL, findings, read, tasks

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DAY = "%Y-%m-%d %H:%M:%S"


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query(f"WITH {FINDINGS_SQL} SELECT job, verdict, count(*) AS n FROM f GROUP BY job, verdict")
def summary_by_verdict(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy("job", "verdict").agg(F.count("*").alias("n"))


@query(f'WITH {FINDINGS_SQL} SELECT job, "check", verdict, count(*) AS n FROM f GROUP BY ROLLUP (job, "check", verdict)')
def summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).rollup("job", "check", "verdict").agg(F.count("*").alias("n"))


def upsert(rows: DataFrame, keys: list[str], payload: list[str], order: str, created: str, refresh: bool) -> DataFrame:
    """Last write of each key wins; its creation time is the first write's, or the last's with `refresh`.

    Aggregates are partial on the map side, so a key with most of the writes costs one row a task.
    """
    when = F.max_by(created, order) if refresh else F.min_by(created, order)
    return rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in payload], when.alias("created"), F.count("*").alias("writes"))


@query(
    f"""WITH {FINDINGS_SQL} SELECT citation_id, "check", max_by(verdict, seq) AS verdict,
    strftime(min_by(created, seq), '{DAY}') AS created, count(*) AS writes FROM f GROUP BY citation_id, "check" """
)
def finding_upsert(spark: SparkSession, d: str) -> DataFrame:
    out = upsert(findings(spark, d), ["citation_id", "check"], ["verdict"], "seq", "created", False)
    return out.withColumn("created", stamp("created"))


@query(
    f"""WITH {FINDINGS_SQL} SELECT job, "check", verdict, max_by(value, seq) AS value,
    strftime(max_by(created, seq), '{DAY}') AS created, count(*) AS writes FROM f GROUP BY job, "check", verdict"""
)
def signal_upsert(spark: SparkSession, d: str) -> DataFrame:
    out = upsert(findings(spark, d), ["job", "check", "verdict"], ["value"], "seq", "created", True)
    return out.withColumn("created", stamp("created"))


@query(f"WITH {FINDINGS_SQL} SELECT citation_id, verdict, min(seq) AS source_id, min_by(value, seq) AS value FROM f GROUP BY ALL")
def insert_or_get(spark: SparkSession, d: str) -> DataFrame:
    """The first insert of each key stays; later ones get it."""
    rows = findings(spark, d)
    return rows.groupBy("citation_id", "verdict").agg(F.min("seq").alias("source_id"), F.min_by("value", "seq").alias("value"))


# fixed values: state that each event leads to
STATES = {"signup": "queued", "view": "fetching", "click": "fetching", "purchase": "fetched", "error": "unavailable"}


@query(
    """SELECT user_id AS cluster_id, CASE max_by(event_type, event_id) WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'fetched'
    WHEN 'error' THEN 'unavailable' ELSE 'fetching' END AS state, count(*) FILTER (WHERE event_type IN ('view','click')) AS attempts,
    max_by(event_type, event_id) IN ('purchase','error') AS terminal FROM events GROUP BY user_id"""
)
def acquisition_state(spark: SparkSession, d: str) -> DataFrame:
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    rows = read(spark, d, "events").withColumn("state", state[F.col("event_type")])
    return (
        rows.groupBy(F.col("user_id").alias("cluster_id"))
        .agg(F.max_by("state", "event_id").alias("state"), F.count_if(F.col("state") == "fetching").alias("attempts"))
        .withColumn("terminal", F.col("state").isin("fetched", "unavailable"))
    )


@query(f"WITH {FINDINGS_SQL} SELECT job, citation_id, ['green','grey','yellow','red'][max({RANK_SQL})] AS tone FROM f GROUP BY ALL")
def worst_tone(spark: SparkSession, d: str) -> DataFrame:
    worst = F.element_at(F.array(*map(F.lit, TONES)), F.max(tone_rank(F.col("verdict"))))
    return findings(spark, d).groupBy("job", "citation_id").agg(worst.alias("tone"))


@query(
    f"""WITH {FINDINGS_SQL} SELECT verdict, {TONE_SQL} AS tone,
    {LABEL_SQL} AS label, count(*) AS n FROM f GROUP BY ALL"""
)
def verdict_label(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("verdict")
    return findings(spark, d).groupBy("verdict").agg(F.count("*").alias("n")).select("verdict", tone(v).alias("tone"), label(v).alias("label"), "n")


@query(f"""WITH {FINDINGS_SQL} SELECT DISTINCT citation_id FROM f WHERE "check" = 'quote' AND {RANK_SQL} = 4 AND value > 20""")
def tone_check_filter(spark: SparkSession, d: str) -> DataFrame:
    """Citations with one finding that is of the check and of the tone at once."""
    both = (F.col("check") == "quote") & (tone(F.col("verdict")) == "red") & (F.col("value") > 20)
    return findings(spark, d).where(both).select("citation_id").distinct()


@query(f'WITH {FINDINGS_SQL} SELECT job, "check", count(*) AS issues FROM f WHERE {RANK_SQL} <> 1 GROUP BY ALL')
def issue_filter(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).where(is_issue(F.col("verdict"))).groupBy("job", "check").agg(F.count("*").alias("issues"))


@query(
    f"""WITH {FINDINGS_SQL} SELECT c_nationkey AS job, coalesce(verdict, 'PENDING') AS verdict, count(*) AS n,
    coalesce(string_agg(DISTINCT "check", ',' ORDER BY "check"), '') AS checks
    FROM customer LEFT JOIN f ON citation_id = c_custkey GROUP BY ALL"""
)
def summary_with_pending(spark: SparkSession, d: str) -> DataFrame:
    """Counts by verdict; a citation without a finding counts as PENDING."""
    rows = read(spark, d, "customer").join(findings(spark, d), F.col("citation_id") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("c_nationkey").alias("job"), F.coalesce("verdict", F.lit("PENDING")).alias("verdict")).agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("check")), ",").alias("checks")
    )


@query(
    """SELECT o_orderkey AS job, count(l_orderkey) AS total, count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag <> 'N') AS quoted,
    count(*) FILTER (WHERE l_linestatus = 'F') AS done,
    count(l_orderkey) > 0 AND count(l_orderkey) = count(*) FILTER (WHERE l_linestatus = 'F') AS complete
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def job_completeness(spark: SparkSession, d: str) -> DataFrame:
    """A job is complete when it has work and all its parts are done: one pass of conditional counts."""
    jobs, work = read(spark, d, "orders").select("o_orderkey"), read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    # dealt once by job, which serves the join and the counts; so no task holds more than some jobs
    parts = tasks(max(jobs.count(), work.count()), 5 * EACH)
    rows = jobs.repartition(parts, "o_orderkey").join(work.repartition(parts, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return (
        rows.groupBy(F.col("o_orderkey").alias("job"))
        .agg(
            F.count("l_orderkey").alias("total"),
            F.countDistinct(F.when(F.col("l_returnflag") != "N", F.col("l_linenumber"))).alias("quoted"),
            F.count_if(F.col("l_linestatus") == "F").alias("done"),
        )
        .withColumn("complete", (F.col("total") > 0) & (F.col("total") == F.col("done")))
    )


@query(
    """SELECT o_orderkey AS citation_id, coalesce(string_agg(l_linenumber || ':' || l_returnflag, '|' ORDER BY l_linenumber, l_returnflag), '')
    AS children, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def nested_children(spark: SparkSession, d: str) -> DataFrame:
    """Parents with their ordered children as one value; parents without children stay."""
    rows = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    child = F.struct("l_linenumber", "l_returnflag")
    listed = F.array_sort(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), child)))
    return rows.groupBy(F.col("o_orderkey").alias("citation_id")).agg(
        F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"])), "|").alias("children"),
        F.count("l_orderkey").alias("n"),
    )


@query(
    """SELECT a.conv_id, a.turn, CASE WHEN a.turn = 0 THEN 'not_applicable' WHEN b.turn IS NULL THEN 'unresolved' ELSE 'resolved' END AS state,
    b.role AS antecedent_role FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1"""
)
def self_antecedent(spark: SparkSession, d: str) -> DataFrame:
    """Each row with the row it refers to; a dangling reference is unresolved."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("antecedent_role"))
    state = F.when(F.col("turn") == 0, "not_applicable").when(F.col("antecedent_role").isNull(), "unresolved").otherwise("resolved")
    return rows.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", state.alias("state"), "antecedent_role")


@query(
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM conversations"""
)
def asof_last_user_turn(spark: SparkSession, d: str) -> DataFrame:
    """The most recent earlier row of a kind, as a backward as-of join by window."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return read(spark, d, "conversations").select("conv_id", "turn", seen.alias("last_user"))


@query(
    """SELECT c_custkey AS target, count(o_orderkey) > 0 AS cached, count(o_orderkey) AS hits
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey"""
)
def cache_left_join(spark: SparkSession, d: str) -> DataFrame:
    cache = read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("hits"))
    hits = F.coalesce("hits", F.lit(0))
    return read(spark, d, "customer").join(cache, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("target"), (hits > 0).alias("cached"), hits.alias("hits")
    )


@query("SELECT c_custkey AS target FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def uncached_anti(spark: SparkSession, d: str) -> DataFrame:
    have = read(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("target"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("target")).join(have, "target", "left_anti")


@query("SELECT c_custkey AS target, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_in_set(spark: SparkSession, d: str) -> DataFrame:
    wanted = read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("target"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("target"), "c_mktsegment").join(wanted, "target", "left_semi")


@query(
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 1000 ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END
    NULLS LAST, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END NULLS LAST, o_orderkey) AS pos FROM orders"""
)
def review_order_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Review order within a job: page, then offset, both with nulls last, then id."""
    rows = read(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 1000).alias("job"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("page"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("start"),
    )
    w = Window.partitionBy("job").orderBy(F.asc_nulls_last("page"), F.asc_nulls_last("start"), "o_orderkey")
    return rows.select("o_orderkey", F.row_number().over(w).alias("pos"))


@query(f"WITH {FINDINGS_SQL} SELECT regexp_replace('page:' || citation_id, '^page:', '') AS page, max(value) AS score FROM f GROUP BY 1")
def page_signal_max(spark: SparkSession, d: str) -> DataFrame:
    ref = F.concat(F.lit("page:"), F.col("citation_id").cast("string"))
    return findings(spark, d).groupBy(F.regexp_replace(ref, "^page:", "").alias("page")).agg(F.max("value").alias("score"))


@query(
    """SELECT event_id, user_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts <= a.ts
    AND b.ts > a.ts - INTERVAL 6 HOURS) AS in_window FROM events a"""
)
def sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    """How many requests of a key the sliding window holds at each request; those exactly a window old have expired."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-(6 * 3600 * 1_000_000 - 1), 0)
    rows = read(spark, d, "events").select("event_id", "user_id", micros.alias("at"))
    return rows.select("event_id", "user_id", F.count("*").over(w).alias("in_window"))


@query(
    """SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 60 AS batch,
    (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 60 AS slot FROM events"""
)
def batch_packing_count(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a key in batches of 60."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return read(spark, d, "events").select("user_id", "event_id", nth.alias("n")).select(
        "user_id", "event_id", F.floor(F.col("n") / 60).alias("batch"), (F.col("n") % 60).cast("bigint").alias("slot")
    )


@query(
    """SELECT o_orderkey AS citation_id, c_name AS case_name, coalesce(n_name, 'unknown') AS court, sha256(c_name) AS sha256,
    count(l_orderkey) AS passages, round(sum(l_extendedprice), 2) AS weight
    FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY ALL"""
)
def evidence_table(spark: SparkSession, d: str) -> DataFrame:
    """One report row per citation with its source, provenance hash and evidence."""
    rows = (
        read(spark, d, "orders").where("o_orderstatus <> 'F'")
        .join(read(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    )
    return rows.groupBy(
        F.col("o_orderkey").alias("citation_id"), F.col("c_name").alias("case_name"), F.coalesce("n_name", F.lit("unknown")).alias("court")
    ).agg(
        F.sha2(F.first("c_name"), 256).alias("sha256"), F.count("l_orderkey").alias("passages"), F.round(F.sum("l_extendedprice"), 2).alias("weight")
    )
