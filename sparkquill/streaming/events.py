"""Event streams: latest state by key, dedupe, session and completion counts, with batch equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.sources.tables import own_path, read
from sparkquill.streaming import state
from sparkquill.streaming.state import Window  # noqa: F401

QUERIES, SQL = {}, {}
#: Files of a batch at most.
FILES = 256
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream; times become timestamps of the session's zone, which watermarks need."""
    rows = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", FILES).parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def drained(rows: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and gives its result table, which lies in the shared folder, as does the stream's checkpoint.

    Appended rows go to files; a complete result overwrites the one before. Nothing of it passes through the driver.
    """
    spark = rows.sparkSession
    path = own_path(spark, "stream")
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/table")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/table"))
    query = writer.start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/table")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT user_id, max_by(event_type, event_id) AS last_type, count(*) AS n FROM events GROUP BY user_id")
def streaming_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest state of each key, as upserts leave it."""
    rows = stream(spark, d).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.count("*").alias("n"))
    return drained(rows, "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streaming_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One event of each key: tasks are run once however often they are queued."""
    rows = stream(spark, d).withWatermark("at", "400 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return drained(rows.select("user_id", "event_type"), "append")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) AS total, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id")
def streaming_completion(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d).groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("done"), F.count("*").alias("total"), F.bool_or(F.col("event_type") == "error").alias("failed")
    )
    return drained(rows, "complete")


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def streaming_daily(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of a day."""
    rows = stream(spark, d).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return drained(rows, "complete").select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "total")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS n FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins, count(*) AS n FROM s GROUP BY user_id, s.n"""
)
def streaming_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: an event within 12 hours of the one before belongs to its session."""
    rows = stream(spark, d).groupBy("user_id", F.session_window("at", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return drained(rows, "complete").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("begins"), "n")


def micros(ts) -> Column:
    """Microseconds of a time without a zone since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


@query(
    """WITH e AS (SELECT user_id, min(struct_pack(a := ts, b := event_id)) AS over FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type IN ('purchase', 'error') GROUP BY user_id)
    SELECT user_id, event_id, event_type FROM events LEFT JOIN e USING (user_id) WHERE ts >= TIMESTAMP '2024-01-10' AND (over IS NULL OR struct_pack(a := ts, b := event_id) <= over)"""
)
def streaming_feed(spark: SparkSession, d: str) -> DataFrame:
    """What a subscriber sees of each key from a moment on: its events up to the first terminal one, nothing of before."""
    rows = stream(spark, d).where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).select("user_id", "event_id", micros(F.col("ts")).alias("micros"), "event_type")
    return state.kept_by_state(rows, "user_id", state.Feed(), state.FEED, own_path(spark, "feed"))


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_id % 14 AS amount, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s(user_id, n, event_id, outcome, available, held) AS (
      SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, []::STRUCT(t BIGINT, a BIGINT)[] FROM events
      UNION ALL SELECT user_id, n, event_id, outcome, CASE WHEN outcome = 'refused' THEN kept[1].t + {state.SECONDS * 1_000_000} ELSE t END,
        CASE WHEN amount = 0 OR outcome = 'error' THEN held WHEN outcome = 'refused' THEN kept ELSE list_append(kept, {{'t': t, 'a': amount}}) END
      FROM (SELECT *, CASE WHEN amount > {state.CAPACITY} THEN 'error' WHEN amount > 0 AND coalesce(list_sum(list_transform(kept, lambda x: x.a)), 0) + amount > {state.CAPACITY} THEN 'refused' ELSE 'admitted' END AS outcome
        FROM (SELECT e.user_id, e.n, e.event_id, e.t, e.amount, s.held, list_filter(s.held, lambda x: x.t > e.t - {state.SECONDS * 1_000_000}) AS kept FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))
    SELECT user_id, event_id, outcome, available FROM s WHERE n > 0"""
)
def streaming_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Requests of an amount each, with their outcome under the sliding window of their key and when they could be had."""
    rows = stream(spark, d).select("user_id", "event_id", micros(F.col("ts")).alias("micros"), (F.col("event_id") % 14).alias("amount"))
    return state.kept_by_state(rows, "user_id", state.Limiter(), state.TOLD, own_path(spark, "limiter"))


def job_facts(rows: DataFrame) -> DataFrame:
    """FACTS of events: a user is a job of three citations; events declare these, quote, find, and start or end runs."""
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    found = F.element_at(F.array(F.lit("existence"), F.lit("quoted"), F.lit("proposition")), (F.floor(k / 3) % 3 + 1).cast("int"))
    named = F.when(kind == "click", "citation").when(kind == "view", F.when(F.col("value") > 60, "quote")).when(kind == "purchase", found).when(kind == "signup", F.when(F.col("value") > 60, "run")).otherwise("run_done")
    return rows.select(F.col("user_id").alias("job"), "at", F.col("event_id").alias("seq"), named.alias("kind"), (k % 3).alias("citation")).where("kind is not null")


@query(
    """WITH f AS (SELECT DISTINCT user_id AS job, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS citation,
      CASE event_type WHEN 'click' THEN 'citation' WHEN 'view' THEN CASE WHEN value > 60 THEN 'quote' END WHEN 'purchase' THEN
        ['existence', 'quoted', 'proposition'][CAST(json_extract_string(props, '$.k') AS BIGINT) // 3 % 3 + 1] WHEN 'signup' THEN CASE WHEN value > 60 THEN 'run' END ELSE 'run_done' END AS kind FROM events),
    c AS (SELECT job, citation, bool_or(kind = 'citation') AS known, bool_or(kind = 'existence') AS e, bool_or(kind = 'quote') AS q, bool_or(kind = 'quoted') AS qd, bool_or(kind = 'proposition') AS p,
      bool_or(kind IN ('run', 'run_done')) AS r, bool_or(kind = 'run_done') AS rd FROM f WHERE kind IS NOT NULL GROUP BY ALL),
    n AS (SELECT job, count(*) FILTER (WHERE known) AS total, count(*) FILTER (WHERE known AND e) AS existence, count(*) FILTER (WHERE known AND q) AS quotes, count(*) FILTER (WHERE known AND qd) AS quoted,
      count(*) FILTER (WHERE known AND p) AS proposition, count(*) FILTER (WHERE known AND r) AS runs, count(*) FILTER (WHERE known AND rd) AS runs_done FROM c GROUP BY job)
    SELECT *, total > 0 AND total = existence AND total = proposition AND quotes = quoted AND runs = runs_done AS complete FROM n"""
)
def job_six_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a job's completion needs, as a batch: citations, existence findings, quotes wanted and answered, proposition findings, runs and finished runs."""
    facts = job_facts(read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")))
    kind = F.col("kind")
    there = lambda *kinds: F.coalesce(F.bool_or(kind.isin(*kinds)), F.lit(False))
    named = {"existence": ("existence",), "quotes": ("quote",), "quoted": ("quoted",), "proposition": ("proposition",), "runs": ("run", "run_done"), "runs_done": ("run_done",)}
    each = facts.groupBy("job", "citation").agg(there("citation").alias("total"), *[there(*k).alias(name) for name, k in named.items()])
    n = each.groupBy("job").agg(*[F.count_if(F.col("total") & F.col(c)).alias(c) for c in state.COUNTS])
    c = F.col
    agree = (c("total") > 0) & (c("total") == c("existence")) & (c("total") == c("proposition")) & (c("quotes") == c("quoted")) & (c("runs") == c("runs_done"))
    return n.withColumn("complete", agree)


@query(
    """WITH f AS (SELECT user_id AS job, ts, event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS citation,
      CASE event_type WHEN 'click' THEN 'citation' WHEN 'view' THEN CASE WHEN value > 60 THEN 'quote' END WHEN 'purchase' THEN
        ['existence', 'quoted', 'proposition'][CAST(json_extract_string(props, '$.k') AS BIGINT) // 3 % 3 + 1] WHEN 'signup' THEN CASE WHEN value > 60 THEN 'run' END ELSE 'run_done' END AS kind FROM events),
    g AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, seq) AS n FROM f WHERE kind IS NOT NULL),
    c AS (SELECT job, citation, min(n) FILTER (WHERE kind = 'citation') AS known, min(n) FILTER (WHERE kind = 'existence') AS e, min(n) FILTER (WHERE kind = 'quote') AS q, min(n) FILTER (WHERE kind = 'quoted') AS qd,
      min(n) FILTER (WHERE kind = 'proposition') AS p, min(n) FILTER (WHERE kind IN ('run', 'run_done')) AS r, min(n) FILTER (WHERE kind = 'run_done') AS rd FROM g GROUP BY ALL),
    a AS (SELECT g.job, g.ts, g.seq, g.n, count(*) FILTER (WHERE known <= g.n) AS total, count(*) FILTER (WHERE known <= g.n AND e <= g.n) AS existence, count(*) FILTER (WHERE known <= g.n AND q <= g.n) AS quotes,
      count(*) FILTER (WHERE known <= g.n AND qd <= g.n) AS quoted, count(*) FILTER (WHERE known <= g.n AND p <= g.n) AS proposition, count(*) FILTER (WHERE known <= g.n AND r <= g.n) AS runs,
      count(*) FILTER (WHERE known <= g.n AND rd <= g.n) AS runs_done FROM g JOIN c USING (job) GROUP BY ALL)
    SELECT job, seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS completed_at, total, existence, quotes, quoted, proposition, runs, runs_done FROM a
    WHERE total > 0 AND total = existence AND total = proposition AND quotes = quoted AND runs = runs_done QUALIFY row_number() OVER (PARTITION BY job ORDER BY n) = 1"""
)
def streaming_job_completion(spark: SparkSession, d: str) -> DataFrame:
    """Each job's completion, once: streams of citations, claims, findings and runs, whose counts have to agree.

    The table's files come in no order of time, so the delay spans all of it; a feed in order needs no more than its own delay.
    """
    done = state.completions(lambda: job_facts(stream(spark, d)), own_path(spark, "completion"), "400 days")
    return done.withColumn("completed_at", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss"))


# fixed values: the fields of each kind of event
KINDS = {"finding": {"id": "bigint", "score": "double"}, "job": {"id": "bigint", "state": "string"}}
REJECTED = "text string, reason string"


def opened(text: Column) -> Column:
    """An envelope `{event, data}` as (kind, fields of each kind, reason): the reason why it doesn't fit is null if it does.

    Texts that aren't JSON or no object, kinds that aren't known, and data that lacks a field of its kind or has one of another type, don't fit.
    """
    v = F.try_parse_json(text)
    kind = F.try_variant_get(v, "$.event", "string")
    data = {k: F.struct(*[F.try_variant_get(v, f"$.data.{f}", t).alias(f) for f, t in fields.items()]) for k, fields in KINDS.items()}
    # a value of another type may be cast, so its own type is held against what is asked
    named = {"bigint": ("BIGINT",), "double": ("DOUBLE", "DECIMAL", "BIGINT"), "string": ("STRING",)}
    fits = lambda f, t: F.coalesce(F.exists(F.array(*map(F.lit, named[t])), lambda x: F.startswith(F.schema_of_variant(F.try_variant_get(v, f"$.data.{f}", "variant")), x)), F.lit(False))
    wrong = F.lit(False)
    for k, fields in KINDS.items():
        for f, t in fields.items():
            wrong = wrong | (kind == k) & ~fits(f, t)
    reason = F.when(v.isNull(), "not JSON").when(F.coalesce(~kind.isin(*KINDS), F.lit(True)), "unknown event").when(wrong, "data")
    return F.struct(kind.alias("kind"), reason.alias("reason"), *[F.when(reason.isNull() & (kind == k), c).alias(k) for k, c in data.items()])


def enveloped(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) of a stream of texts: what fits, by kind, and beside it what doesn't, with the reason. A batch that is written anew gives the same files."""
    spark = rows.sparkSession
    found = rows.select("text", opened(F.col("text")).alias("e"))

    def run(batch: DataFrame, number: int) -> None:
        batch.where("e.reason is null").select("e.kind", *[f"e.{k}" for k in KINDS]).write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        batch.where("e.reason is not null").select("text", "e.reason").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")

    found.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(run).start().awaitTermination()
    fits = found.select("e.kind", *[f"e.{k}" for k in KINDS]).schema
    kept = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")
    return kept("events", fits), kept("rejected", REJECTED)


def envelopes(rows: DataFrame) -> DataFrame:
    """Events as envelopes: errors and purchases as findings with a score, others as jobs with a state; some cut off, of another kind, or with data that doesn't fit."""
    i, score = F.col("event_id"), F.when(F.col("event_id") % 23 == 0, F.lit('"high"')).otherwise(F.col("value").cast("string"))
    finding = F.concat(F.lit('{"event": "finding", "data": {"id": '), i, F.lit(', "score": '), score, F.lit("}}"))
    state = F.when(i % 29 == 0, F.lit("}}")).otherwise(F.concat(F.lit(', "state": "'), F.col("event_type"), F.lit('"}}')))
    job = F.concat(F.lit('{"event": "'), F.when(i % 19 == 0, "ping").otherwise("job"), F.lit('", "data": {"id": '), i, state)
    text = F.when(F.col("event_type").isin("error", "purchase"), finding).otherwise(job)
    return rows.select(F.when(i % 17 == 0, F.left(text, F.length(text) - 3)).otherwise(text).alias("text"))


@query(
    """WITH e AS (SELECT *, event_type IN ('error', 'purchase') AS f FROM events),
    r AS (SELECT CASE WHEN event_id % 17 = 0 THEN 'not JSON' WHEN NOT f AND event_id % 19 = 0 THEN 'unknown event' WHEN f AND event_id % 23 = 0 THEN 'data' WHEN NOT f AND event_id % 29 = 0 THEN 'data' END AS reason, * FROM e)
    SELECT CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN f THEN 'finding' ELSE 'job' END AS kind, coalesce(reason, CASE WHEN NOT f THEN event_type END, '') AS what, count(*) AS n,
      round(sum(CASE WHEN reason IS NULL AND f THEN value END), 2) AS score FROM r GROUP BY ALL"""
)
def event_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes by kind and state, with the scores' sum, and the rejected ones by reason."""
    good, bad = enveloped(envelopes(stream(spark, d)), own_path(spark, "envelopes"))
    counted = good.groupBy("kind", F.coalesce("job.state", F.lit("")).alias("what")).agg(F.count("*").alias("n"), F.round(F.sum("finding.score"), 2).alias("score"))
    return counted.unionByName(bad.groupBy(F.lit("rejected").alias("kind"), F.col("reason").alias("what")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("score")))
