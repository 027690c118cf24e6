"""Target-distribution importance resampling by an external sort-count.

Texts become streams of packed uint16 bucket numbers with the offsets of their documents, written to a table. Each stream is sorted and
run-length encoded, and Spark adds up the runs: these are the corpus's counts of each bucket. From them and those of the target texts
follow the buckets' gains, which are gathered along the stored streams and added up by document with np.add.reduceat. Documents are
drawn by the highest sums of weight and Gumbel noise, ranked by a range-partitioned sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import stored, table, text_chunks

#: Words of a feature at most, buckets, words that a document has to have, documents drawn of 100, seed.
RUNS, BUCKETS, LEAST, SHARE, SEED = 1, 10_000, 20, 10, 2024
#: Rows of a partition of the sort, on average.
SORTED = 1_000_000
#: Digits, letters after lower-casing A-Z, and all bytes of characters beyond ASCII stay; others part words.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes, runs: int, buckets: int):
    """(words, buckets of all runs of 1 to `runs` consecutive words)."""
    import zlib

    import numpy as np

    words = text.translate(PLAIN).split(b" ")
    words = [w for w in words if w]
    found = [np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))]
    for n in range(2, runs + 1):
        grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        found.append(np.fromiter(map(zlib.crc32, grams), dtype=np.uint32, count=len(grams)))
    return len(words), (np.concatenate(found) % np.uint32(buckets)).astype("<u2")


def streams(docs: DataFrame, id_col: str, text_col: str, runs: int, buckets: int, name: str) -> DataFrame:
    """(ids, words, ends, stream), stored: of each slice of documents their ids, words, ends in the stream, and the stream of bucket numbers."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("bucket numbers have to fit 16 bits")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in text_chunks(batches):
            each = [features(t or b"", runs, buckets) for t in part.column(1).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([len(s) for _, s in each])
            lists = [part.column(0).to_pylist()], [[n for n, _ in each]], [ends.tolist()], [np.concatenate([s for _, s in each]).tobytes()]
            kinds = pa.list_(part.column(0).type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(lists, kinds)], ["ids", "words", "ends", "stream"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return stored(rows.mapInArrow(run, f"ids array<{kind}>, words array<bigint>, ends array<bigint>, stream binary"), name)


def counts(rows: DataFrame, buckets: int):
    """How often each bucket is in the streams. `buckets` sums come to the driver at most."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_py(), dtype="<u2"))
                starts = np.flatnonzero(np.diff(ordered, prepend=-1 if len(ordered) else ()) != 0) if len(ordered) else np.zeros(0, np.int64)
                n = np.diff(np.append(starts, len(ordered)))
                yield pa.RecordBatch.from_arrays([pa.array(ordered[starts].astype(np.int32)), pa.array(n, pa.int64())], ["bucket", "n"])

    total = np.zeros(buckets, dtype=np.int64)
    for r in rows.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r[0]] = r[1]
    return total


def gains(source, target):
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each of B buckets, in doubles."""
    import numpy as np

    b, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + b) / ((s + 1.0) * (all_t + b)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighed(rows: DataFrame, gain, id_col: str) -> DataFrame:
    """(__id, __words, n_features, weight) of the documents of stored streams."""
    kind = rows.schema["ids"].dataType.elementType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(gain)  # as many numbers as buckets

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for ids, words, ends, stream in zip(*batch.columns):
                ends = np.asarray(ends.values, dtype=np.int64)
                sizes = np.diff(ends, prepend=0)
                got = sent.value[np.frombuffer(stream.as_py(), dtype="<u2")]
                weight, full = np.zeros(len(ends), np.int64), np.flatnonzero(sizes)
                if len(full):
                    weight[full] = np.add.reduceat(got, (ends - sizes)[full])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(sizes), pa.array(weight)], ["__id", "__words", "n_features", "weight"])

    return rows.select("ids", "words", "ends", "stream").mapInArrow(run, f"__id {kind}, __words bigint, n_features bigint, weight bigint")


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 8 hex digits of sha256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with __rank, from 1, in this order over all rows: a range-partitioned sort and the partitions' sizes before each.

    One row for each partition comes to the driver, SORTED rows being one on average.
    """
    parts = max(1, -(-rows.count() // SORTED))
    parts = max(parts, min(8 * parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("__at", place), name)
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes, before, total = dealt.groupBy(part.alias("p")).count().collect(), [], 0
    for p, n in sorted((r[0], r[1]) for r in sizes):
        before.append((p, total))
        total += n
    first = rows.sparkSession.createDataFrame(before, "__part bigint, __before bigint")
    return dealt.join(F.broadcast(first), part == F.col("__part")).withColumn("__rank", within + F.col("__before") + 1).drop("__at", "__part", "__before")


def importance_sample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    runs: int = RUNS, buckets: int = BUCKETS, least: int = LEAST, share: int = SHARE, seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank (null where it isn't drawn).

    Of the rows with `least` words or more, floor(share * rows / 100) are drawn: those of the highest scores, ties to smaller ids, null ids
    last. Null texts have no words and weight 0. Rows that repeat an id are drawn each, and a null id draws as an empty one. An empty target counts as one
    without features; an empty table gives no rows; other columns aren't read.
    """
    source = streams(docs, id_col, text_col, runs, buckets, "streams")
    aim = streams(target.select(F.lit(0).alias("__none"), F.col(f"`{target_col}`").alias("__text")), "__none", "__text", runs, buckets, "target-streams")
    found = weighed(source, gains(counts(source, buckets), counts(aim, buckets)), id_col)
    found = found.select("__id", "__words", "n_features", "weight", (F.col("weight") + gumbel(F.col("__id"), seed)).alias("score"))
    # rows that are alike are told apart, so that the sort can deal them to several tasks
    found = stored(found.withColumn("__row", F.monotonically_increasing_id()), "scores")
    may = F.col("__words") >= least
    drawn = found.where(may).count() * share // 100
    order = [F.col("score").desc(), F.col("__id").asc_nulls_last(), F.col("__row").asc()]
    able = ranked(found.where(may), order, "drawn").withColumn("rank", F.when(F.col("__rank") <= drawn, F.col("__rank")))
    names = ["__id", "n_features", "weight", "score", "rank"]
    others = found.where(~may).withColumn("rank", F.lit(None).cast("bigint"))
    return able.select(*names).unionByName(others.select(*names)).withColumnRenamed("__id", id_col)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 by its table, byte by byte, over the distinct words.
OP13_SQL = r"""
WITH RECURSIVE bits(b, step, c) AS (SELECT b, 0, b::BIGINT FROM range(256) r(b)
  UNION ALL SELECT b, step + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8),
texts AS (SELECT doc_id AS k, false AS aim, text AS x FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
words AS (SELECT k, aim, unnest(regexp_extract_all(translate(coalesce(x, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
tf AS (SELECT k, aim, w, count(*) AS n FROM words GROUP BY ALL),
hashed AS (SELECT w, xor(list_reduce(list_transform(range(length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), i * 2 + 1, 2))::BIGINT),
    lambda a, y: xor(a // 256, t[xor(a % 256, y) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM (SELECT DISTINCT w FROM tf), crc),
per AS (SELECT k, aim, bucket, sum(n) AS n FROM tf JOIN hashed USING (w) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (NOT aim), 0) AS s, coalesce(sum(n) FILTER (aim), 0) AS t FROM per GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM sums),
docs AS (SELECT doc_id, coalesce(sum(n), 0)::BIGINT AS n_features, coalesce(sum(n * g), 0)::BIGINT AS weight
  FROM documents LEFT JOIN (SELECT k, bucket, n FROM per WHERE NOT aim) p ON p.k = doc_id LEFT JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS c FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * c // 100 THEN r END AS rank FROM scored LEFT JOIN able USING (doc_id)"""
