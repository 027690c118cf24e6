"""Keyed state of event streams: jobs that are complete once all counts agree, feeds up to their end, sliding windows of a limiter.

State is kept by Spark (a map or a value for each key, with timers) under the stream's checkpoint; a batch costs as much as the keys that it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def kept_by_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, path: str, time: str = "None") -> DataFrame:
    """What a processor gives for what is there of a stream by now, in files under `path`; called again, it goes on from the stream's checkpoint."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = rows.groupBy(key).transformWithState(processor, schema, "Append", time)
        writer = out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{path}/table").start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema(schema).parquet(f"{path}/table")


#: What a job's completion needs, as rows: kind (citation, quote, existence, quoted, proposition, run, run_done) of a citation at a time.
FACTS = "job bigint, at timestamp, seq bigint, kind string, citation bigint"
#: What must be as many as what: all citations have existence and proposition findings, all quotes and runs are answered.
COUNTS = ("total", "existence", "quotes", "quoted", "proposition", "runs", "runs_done")
KIND_OF = {"citation": "total", "existence": "existence", "quote": "quotes", "quoted": "quoted", "proposition": "proposition", "run": "runs", "run_done": "runs_done"}
DONE = "job bigint, completed_at timestamp, seq bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)


def agree(n: dict[str, int]) -> bool:
    return n["total"] > 0 and n["total"] == n["existence"] == n["proposition"] and n["quotes"] == n["quoted"] and n["runs"] == n["runs_done"]


def held(state) -> list[tuple]:
    """What a list of the state holds."""
    return [tuple(x) for x in state.get()] if state.exists() else []


class Completion(StatefulProcessor):
    """Gives each job's completion once: the first row, in order of time, after which all counts of its citations agree.

    Facts wait in a list until the watermark has passed them, so that they are gone over in order of time however batches cut them; a timer
    stands at the earliest. Facts count once, so only the first row of each waits, and only when their citation is known, whichever comes first. A completed
    job keeps a mark alone. A list is read and written as a whole, by one call to the state's server.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, seq bigint, kind string, citation bigint")
        self.facts = handle.getListState("facts", "kind string, citation bigint")
        self.counts = handle.getValueState("counts", ", ".join(f"{c} bigint" for c in COUNTS))
        self.done = handle.getValueState("done", "there boolean")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        if self.done.exists():
            return iter(())
        first = self.timer.get()[0] if self.timer.exists() else None
        least = {(kind, citation): (at, seq) for at, seq, kind, citation in held(self.waiting)}
        for r in rows:
            fact, place = (r["kind"], int(r["citation"])), (int(r["micros"]), int(r["seq"]))
            if fact not in least or place < least[fact]:
                least[fact] = place
        for fact in held(self.facts):
            least.pop(fact, None)
        if least:
            self.waiting.put([(*place, *fact) for fact, place in least.items()])
            due = min(least.values())[0] // 1000 + 1
            if due != first:
                if first is not None:
                    self.handle.deleteTimer(first)
                self.handle.registerTimer(due)
                self.timer.update((due,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        if self.done.exists():
            return
        until = timerValues.getCurrentWatermarkInMs()
        # what is waiting is what came within the watermark's delay
        every, facts = sorted(held(self.waiting)), set(held(self.facts))
        n = dict(zip(COUNTS, self.counts.get())) if self.counts.exists() else dict.fromkeys(COUNTS, 0)
        later = None
        rest = []
        for i, (at, seq, kind, citation) in enumerate(every):
            if at // 1000 + 1 > until:
                later, rest = at // 1000 + 1, every[i:]
                break
            self.count(n, facts, kind, citation)
            if agree(n):
                self.done.update((True,))
                for state in (self.waiting, self.facts, self.counts):
                    state.clear()
                yield Row(job=int(key[0]), micros=at, seq=seq, **n)
                return
        self.counts.update(tuple(n[c] for c in COUNTS))
        for state, values in ((self.waiting, rest), (self.facts, sorted(facts))):
            if values:
                state.put(values)
            else:
                state.clear()
        if later is not None:
            self.handle.registerTimer(later)
            self.timer.update((later,))

    def count(self, n: dict[str, int], facts: set, kind: str, citation: int) -> None:
        for fact in ("run", "run_done") if kind == "run_done" else (kind,):
            if (fact, citation) in facts:
                continue
            facts.add((fact, citation))
            if fact == "citation":
                for other, count in KIND_OF.items():
                    n[count] += other == "citation" or (other, citation) in facts
            else:
                n[KIND_OF[fact]] += ("citation", citation) in facts

    def close(self) -> None:
        pass


def completions(facts: Callable[[], DataFrame], path: str, delay: str) -> DataFrame:
    """DONE rows of a stream of FACTS: several streams united. Rows later than `delay` behind the latest, and rows with a null, are left out.

    `facts` gives the stream. When all that is there has been read, a closing row moves the watermark past every row that still waits, and the stream
    goes on from its checkpoint once more; on a stream that doesn't end, later rows do so.
    """
    spark = facts().sparkSession
    closing = f"{path}/closing"
    spark.createDataFrame([], FACTS).write.parquet(closing)
    schema = DONE.replace("completed_at timestamp", "micros bigint")

    def run() -> DataFrame:
        given = facts().na.drop(subset=["job", "at", "seq", "kind", "citation"])
        rows = given.unionByName(spark.readStream.schema(FACTS).parquet(closing)).withWatermark("at", delay)
        return kept_by_state(rows.withColumn("micros", F.unix_micros("at")), "job", Completion(), schema, path, "EventTime")

    run()
    facts_end(spark).write.mode("append").parquet(closing)
    return run().withColumn("completed_at", F.timestamp_micros("micros")).drop("micros")


def facts_end(spark: SparkSession) -> DataFrame:
    """The closing row: of no job, long after everything else."""
    end = F.lit("9000-01-01 00:00:00").cast("timestamp")
    return spark.range(1).select(F.lit(-1).cast("bigint").alias("job"), end.alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit("none").alias("kind"), F.lit(0).cast("bigint").alias("citation"))


# fixed values: events that end a feed
TERMINAL = ("purchase", "error")
FEED = "user_id bigint, event_id bigint, event_type string"


class Feed(StatefulProcessor):
    """A key's rows (micros, event_id, event_type) up to its first terminal one, whose time and id are the key's state.

    Of a batch all rows are told that aren't behind the end known after it. What was told is never taken back by an end that comes late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "micros bigint, event_id bigint")

    def handleInputRows(self, key, rows, timerValues):
        end = tuple(self.end.get()) if self.end.exists() else None
        # rows behind an end that is known by now are never told, so they needn't be held
        told = []
        for r in rows:
            place = (int(r["micros"]), int(r["event_id"]))
            if end is not None and place > end:
                continue
            told.append((place, r["event_type"]))
            if r["event_type"] in TERMINAL:
                end = place
                self.end.update(place)
        for place, kind in told:
            if end is None or place <= end:
                yield Row(user_id=int(key[0]), event_id=place[1], event_type=kind)

    def close(self) -> None:
        pass


#: What a key may use within the seconds of a window.
CAPACITY, SECONDS = 12, 86_400
TOLD = "user_id bigint, event_id bigint, outcome string, available bigint"


class Window:
    """A sliding window of one key: (time, amount) of what it let in, oldest first. CAPACITY entries at most, as amounts are 1 or more."""

    def __init__(self, held=()):
        self.held = [(int(t), int(n)) for t, n in held]

    def ask(self, now: int, amount: int) -> tuple[str, int]:
        """(outcome, when it is available in microseconds). What is exactly a window old has expired; an amount over CAPACITY can never be had."""
        if amount < 0 or amount > CAPACITY:
            return "error", now
        if amount == 0:
            return "admitted", now
        size = SECONDS * 1_000_000
        self.held = [(t, n) for t, n in self.held if t > now - size]
        if sum(n for _, n in self.held) + amount > CAPACITY:
            return "refused", self.held[0][0] + size
        self.held.append((now, amount))
        return "admitted", now


class Limiter(StatefulProcessor):
    """Outcomes of a key's requests (micros, event_id, amount) under its sliding window, which is the key's state: CAPACITY entries at most.

    A key's requests depend on each other: those of a batch are gone over by one task, in order of time, as three numbers each.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "micros bigint, amount bigint")

    def handleInputRows(self, key, rows, timerValues):
        window = Window(self.held.get() if self.held.exists() else ())
        for micros, event, amount in sorted((int(r["micros"]), int(r["event_id"]), int(r["amount"])) for r in rows):
            outcome, available = window.ask(micros, amount)
            yield Row(user_id=int(key[0]), event_id=event, outcome=outcome, available=available)
        if window.held:
            self.held.put(window.held)
        else:
            self.held.clear()

    def close(self) -> None:
        pass
