"""Greedy batches of queues, many tasks to a queue.

Where a batch that begins at a row ends follows from prefix sums alone, so for each row the begin of the next batch is a search. Rows are dealt to
blocks by their place; a block says, for each place where a batch may begin in it, where the first batch of the block after it begins. Blocks are chained by
pointer doubling, and each block then numbers its own batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.sources.tables import read, stored

QUERIES, SQL = {}, {}
#: Rows of a block, and of a partition of the sort on average.
BLOCK, SORTED = 65_536, 1_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def placed(rows: DataFrame) -> DataFrame:
    """rows (g, o, s) with `at`, their place in their queue from 0, and `upto`, the sum of s + 1 up to them: a range-partitioned sort, then what stands before each part."""
    parts = max(1, -(-rows.count() // SORTED))
    parts = max(parts, min(8 * parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("g", "o")]

    def run(pdfs):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        part, queue, at, upto = TaskContext.get().partitionId(), object(), 0, 0
        for pdf in pdfs:
            if not len(pdf):
                continue
            g, s = pdf["g"].astype(object).to_numpy(), pdf["s"].to_numpy() + 1
            none = pd.isna(g)
            new = np.ones(len(g), dtype=bool)
            new[1:] = ~(none[1:] & none[:-1]) & (none[1:] | none[:-1] | (g[1:] != g[:-1]))
            same = queue is None and none[0] or queue is not None and not none[0] and bool(queue == g[0])
            new[0] = not same
            n, sums = np.arange(at, at + len(s)), upto + np.cumsum(s)
            cuts = np.flatnonzero(new)
            for a, b in zip(cuts, np.append(cuts[1:], len(s))):
                n[a:b] = np.arange(b - a)
                sums[a:b] = np.cumsum(s[a:b])
            at, upto, queue = int(n[-1]) + 1, int(sums[-1]), None if none[-1] else g[-1]
            yield pdf[["g", "o", "s"]].assign(part=part, n=n, sums=sums)

    order = ["g", "o", "s", "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    inside = stored(dealt.select("g", "o", "s").mapInPandas(run, f"g {kinds[0]}, o {kinds[1]}, s bigint, part int, n bigint, sums bigint"), "placed")
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = inside.groupBy("g", "part").agg(F.count("*").alias("rows"), F.sum(F.col("s") + 1).alias("all"))
    offsets = sizes.select(F.to_json(F.struct("g")).alias("k"), "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows"), F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("all"))
    # a text stands for each queue, so that null is one as well
    out = inside.withColumn("k", F.to_json(F.struct("g"))).join(offsets, ["k", "part"])
    return out.select("k", "g", "o", "s", (F.col("n") + F.col("rows")).alias("at"), (F.col("sums") + F.col("all")).alias("upto"))


def next_starts(at, s, upto, most: int, room: int):
    """For rows of consecutive places: the place where the next batch begins, if one begins at the row. What isn't among them is taken as not full."""
    import numpy as np

    before = upto - s - 1
    # the first row whose end is more than `room` from the begin; one row at least is in a batch
    end = np.searchsorted(upto, before + room + 1, side="right")
    return at[0] + np.maximum(np.minimum(end, np.arange(len(at)) + most), np.arange(len(at)) + 1)


def batches(rows: DataFrame, group: str, order: str, size: str, most: int, room: int) -> DataFrame:
    """(group, order, batch): rows in order, a new batch where `most` rows are in one or its sizes, a separator between two, would go over `room`.

    A row that is over `room` by itself is a batch of its own. Ties in the order are settled by size. Null sizes count as 0; null groups are one queue; an
    empty table gives none. No task holds a queue: blocks of max(BLOCK, most) rows are the largest groups.
    """
    if most < 1:
        raise ValueError("a batch has one row at least")
    spark, block = rows.sparkSession, max(BLOCK, most)
    slim = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("s"))
    found = stored(placed(slim), "queue-places")
    # each block has the next `most` rows besides, so that it knows where its last batches end
    own = F.floor(F.col("at") / block)
    ahead = F.when((own > 0) & (F.col("at") % block < most), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = found.withColumn("block", F.explode(ahead))
    kind, g_kind, o_kind = (found.schema[c].dataType.simpleString() for c in ("k", "g", "o"))

    def exits(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("at")
        at, end = pdf["at"].to_numpy(), (int(key[1]) + 1) * block
        to = next_starts(at, pdf["s"].to_numpy(), pdf["upto"].to_numpy(), most, room)
        mine = int((at < end).sum())
        n = np.ones(len(to), dtype=np.int64)
        while True:  # jumps are doubled until all leave the block
            inside = np.flatnonzero(to[:mine] < min(end, at[0] + mine))
            if not len(inside):
                break
            by = to[inside] - at[0]
            n[inside] += n[by]
            to[inside] = to[by]
        few = min(mine, most)
        return pd.DataFrame({"k": [key[0]], "block": [key[1]], "to": [(to[:few] - end).tolist()], "n": [n[:few].tolist()]})

    jumps = dealt.groupBy("k", "block").applyInPandas(exits, f"k {kind}, block bigint, to array<bigint>, n array<bigint>")
    jumps = stored(jumps, "queue-jumps")
    last = jumps.agg(F.max("block")).first()[0]
    # (block, place of its first batch, batches before it)
    entries = jumps.where("block = 0").select("k", "block", F.lit(0).cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("before"))
    there, step = jumps.select("k", "block"), 1
    while last is not None and step <= last:
        on = entries.join(jumps.select("k", "block", "to", "n"), ["k", "block"])
        more = on.select("k", (F.col("block") + step).alias("block"), F.get("to", F.col("entry").cast("int")).alias("entry"), (F.col("before") + F.get("n", F.col("entry").cast("int"))).alias("before"))
        entries = stored(entries.unionByName(more.join(there, ["k", "block"], "left_semi")), "queue-entries")
        after = jumps.select("k", (F.col("block") - step).alias("block"), F.col("to").alias("to2"), F.col("n").alias("n2"))
        both = jumps.join(after, ["k", "block"])
        jumps = stored(
            both.select(
                "k", "block", F.transform("to", lambda e: F.get("to2", e.cast("int"))).alias("to"),
                F.zip_with("to", "n", lambda e, n: n + F.get("n2", e.cast("int"))).alias("n"),
            ), "queue-jumps",
        )
        step *= 2

    def number(key, left, right):
        import numpy as np
        import pandas as pd

        left = left.sort_values("at")
        at, end = left["at"].to_numpy(), (int(key[1]) + 1) * block
        to = next_starts(at, left["s"].to_numpy(), left["upto"].to_numpy(), most, room) - at[0]
        mine = int((at < end).sum())
        place, batch = int(right["entry"].iloc[0]), int(right["before"].iloc[0])
        # rows before the first begin belong to the batch that the block before has opened
        starts = np.zeros(mine, dtype=np.int64)
        while place < mine:
            starts[place] = 1
            place = int(to[place])
        return pd.DataFrame({"g": left["g"].iloc[:mine], "o": left["o"].iloc[:mine], "batch": (batch - 1 + np.cumsum(starts)).astype(np.int32)})

    right = entries.select(F.col("k").alias("e_k"), F.col("block").alias("e_block"), "entry", "before")
    out = dealt.groupBy("k", "block").cogroup(right.groupBy("e_k", "e_block")).applyInPandas(number, f"g {g_kind}, o {o_kind}, batch int")
    return out.toDF(group, order, "batch")


def _batches_sql(queue: str, table: str, order: str, size: str, most: int, room: int) -> str:
    over = f"k = {most} OR chars + 1 + c > {room}"
    return f"""WITH RECURSIVE b AS (SELECT {queue} AS queue, {order} AS item_id, {size} AS c, row_number() OVER (PARTITION BY {queue} ORDER BY {order}) AS n FROM {table}),
    r AS (SELECT queue, item_id, n, 0 AS batch, 1 AS k, c AS chars FROM b WHERE n = 1 UNION ALL
      SELECT b.queue, b.item_id, b.n, CASE WHEN {over} THEN batch + 1 ELSE batch END, CASE WHEN {over} THEN 1 ELSE k + 1 END, CASE WHEN {over} THEN c ELSE chars + 1 + c END
      FROM r JOIN b ON b.queue = r.queue AND b.n = r.n + 1)
    SELECT queue, item_id, batch FROM r"""


@query(_batches_sql("item_id % 3", "benchmark", "item_id", "length(text)", 4, 1200))
def batch_packing_greedy(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "benchmark").select((F.col("item_id") % 3).alias("queue"), "item_id", F.length("text").alias("size"))
    return batches(rows, "queue", "item_id", "size", 4, 1200)


@query(_batches_sql("0", "documents", "doc_id", "length(text) % 1500", 60, 64_000))
def lookup_batches(spark: SparkSession, d: str) -> DataFrame:
    """All documents as one queue of requests, by the limits of a lookup: 60 to a request, and 64,000 characters."""
    rows = read(spark, d, "documents").select(F.lit(0).alias("queue"), F.col("doc_id").alias("item_id"), (F.length("text") % 1500).alias("size"))
    return batches(rows, "queue", "item_id", "size", 60, 64_000)
