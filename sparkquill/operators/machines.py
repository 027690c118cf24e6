"""State machines with guards over event logs: an event is a function from states to states, and functions compose.

The log is sorted by key and order into ranges; each range composes the functions of each of its keys, and a key's few compositions are applied
in order to its first state. So a key with most of the events is the work of many tasks, and no task holds its events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.sources.tables import read, stored

QUERIES, SQL = {}, {}
#: Rows of a range on average.
SORTED = 1_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# fixed values: states of an acquisition, and where each event leads from each state; what isn't named stays
STATES = ("queued", "fetching", "fetched", "unavailable")
STEPS = {
    "claim": {"queued": "fetching"},
    "succeed": {"fetching": "fetched"},
    "fail": {"fetching": "unavailable"},
    "retry": {"fetching": "queued"},
}
TERMINAL = ("fetched", "unavailable")


def machine(rows: DataFrame, states: tuple[str, ...] = STATES, steps: dict[str, dict[str, str]] = STEPS, counted: str = "claim") -> DataFrame:
    """(key, state, steps, counted, events) of events (key, at, event): the state that the events lead to in order, from the first of `states` on.

    `steps` tells how many events moved the state, `counted` how many of these were of that kind. Events that no guard lets through, and unknown
    ones, change nothing; so nothing follows a terminal state. Ties in the order go by event. Null keys are a key; events without an order come first.
    """
    names, kind = list(steps), rows.schema["key"].dataType.simpleString()
    number = {s: i for i, s in enumerate(states)}
    table = [[number[steps[e].get(s, s)] for s in states] for e in names]
    parts = max(1, -(-rows.count() // SORTED))
    parts = max(parts, min(8 * parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(pdfs):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        part, size = TaskContext.get().partitionId(), len(states)
        move = np.array([*table, list(range(size))])
        here = np.arange(size)
        key, begun = None, False
        to = moved = hit = None
        events = 0
        for pdf in pdfs:
            out = []
            codes = pdf["event"].map({e: i for i, e in enumerate(names)}).fillna(len(names)).astype(int).to_numpy()
            for k, none, code in zip(pdf["key"].astype(object), pdf["key"].isna(), codes):
                k = None if none else k
                if not begun or k != key:
                    if begun:
                        out.append((key, part, to.tolist(), moved.tolist(), hit.tolist(), events))
                    key, begun, to, moved, hit, events = k, True, here.copy(), np.zeros(size, np.int64), np.zeros(size, np.int64), 0
                new = move[code][to]
                changed = new != to
                moved += changed
                if code < len(names) and names[code] == counted:
                    hit += changed
                to, events = new, events + 1
            yield frame(out, pd)
        if begun:
            yield frame([(key, part, to.tolist(), moved.tolist(), hit.tolist(), events)], pd)

    def frame(out, pd):
        found = pd.DataFrame(out, columns=["key", "part", "to", "moved", "hit", "events"])
        return found.astype({"key": "object"})

    order = ["key", "at", "event", "row"]
    log = rows.select("key", "at", "event").withColumn("row", F.monotonically_increasing_id())
    log = log.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "event")
    pieces = stored(log.mapInPandas(run, f"key {kind}, part int, to array<int>, moved array<bigint>, hit array<bigint>, events bigint"), "compositions")
    # a key has one piece for each range that it reaches into
    listed = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "to", "moved", "hit"))).alias("p"), F.sum("events").alias("events"))
    zero = F.struct(F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("moved"), F.lit(0).cast("bigint").alias("hit"))
    fold = F.aggregate(
        "p", zero, lambda a, x: F.struct(F.get(x["to"], a["s"]).alias("s"), (a["moved"] + F.get(x["moved"], a["s"])).alias("moved"), (a["hit"] + F.get(x["hit"], a["s"])).alias("hit"))
    )
    done = listed.withColumn("f", fold)
    return done.select("key", F.element_at(F.array(*map(F.lit, states)), F.col("f.s") + 1).alias("state"), F.col("f.moved").alias("steps"), F.col("f.hit").alias("counted"), "events")


# fixed values: what each event type of the tables asks of an acquisition
EVENT_OF = {"signup": "claim", "view": "claim", "click": "retry", "purchase": "succeed", "error": "fail"}


@query(
    """WITH RECURSIVE e AS (SELECT event_id % 900 AS cluster_id, CASE event_type WHEN 'purchase' THEN 'succeed' WHEN 'error' THEN 'fail' WHEN 'click' THEN 'retry' ELSE 'claim' END AS event,
      row_number() OVER (PARTITION BY event_id % 900 ORDER BY ts, event_id) AS n FROM events),
    r(cluster_id, n, state, steps, attempts) AS (SELECT DISTINCT cluster_id, 0::BIGINT, 'queued', 0::BIGINT, 0::BIGINT FROM e
      UNION ALL SELECT cluster_id, n, new, steps + (new <> state)::BIGINT, attempts + (event = 'claim' AND new <> state)::BIGINT FROM (SELECT e.cluster_id, e.n, e.event, r.state, r.steps, r.attempts,
        CASE WHEN state = 'queued' AND event = 'claim' THEN 'fetching' WHEN state = 'fetching' AND event = 'succeed' THEN 'fetched' WHEN state = 'fetching' AND event = 'fail' THEN 'unavailable'
          WHEN state = 'fetching' AND event = 'retry' THEN 'queued' ELSE state END AS new FROM r JOIN e ON e.cluster_id = r.cluster_id AND e.n = r.n + 1))
    SELECT cluster_id, max_by(state, n) AS state, max(steps) AS steps, max(attempts) AS attempts, max(n) AS events, max_by(state, n) IN ('fetched', 'unavailable') AS terminal FROM r GROUP BY cluster_id"""
)
def guarded_acquisitions(spark: SparkSession, d: str) -> DataFrame:
    """Acquisitions as their events leave them: a fetch is claimed once, may go back to the queue, and ends for good."""
    named = F.create_map(*[F.lit(x) for pair in EVENT_OF.items() for x in pair])
    rows = read(spark, d, "events").select((F.col("event_id") % 900).alias("key"), F.struct("ts", "event_id").alias("at"), named[F.col("event_type")].alias("event"))
    done = machine(rows).withColumnRenamed("key", "cluster_id").withColumnRenamed("counted", "attempts")
    return done.withColumn("terminal", F.col("state").isin(*TERMINAL))
