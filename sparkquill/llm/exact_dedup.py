"""Exact dedup by a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's ``approx_top_k`` family, a mergeable frequent-items sketch of that kind)
names digests that may be frequent. Their exact counts are taken; the winners that hold at least
``1 / HEAVY_SHARE`` of the rows are broadcast (at most ``CANDIDATES`` rows) and settled map-side. Every other
digest goes through an ordinary shuffle: its size and last row are aggregated map-side first and joined back, so that no
task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.llm.common import ascii_lower, packed, stored, table, unpacked

#: Counters of the summary: a digest with over 1 / (0.75 * COUNTERS) of the rows is never lost from it.
COUNTERS = 16384
#: Digests taken from the summary, and so the bound of what is broadcast.
CANDIDATES = 4096
#: A verified winner has at least a HEAVY_SHARE-th of all rows.
HEAVY_SHARE = 4000
#: Groups that the per-partition summaries are first merged into.
MERGE_GROUPS = 64


def digest(text_col: str) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("binary"), 256))


def frequent(rows: DataFrame) -> DataFrame:
    """(item, total): hashes of digests that may be frequent, from a two-level merge of Misra-Gries summaries."""
    item = F.xxhash64("__digest")
    return (
        rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("__g"))
        .agg(
            F.expr(f"approx_top_k_accumulate(xxhash64(__digest), {COUNTERS})").alias("__s"),
            F.count(item).alias("__n"),
        )
        .groupBy(F.lit("all").alias("__all"))  # by a key, so that partitions without rows have no summary to merge
        .agg(F.expr(f"approx_top_k_combine(__s, {COUNTERS})").alias("__s"), F.sum("__n").alias("__total"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(__s, {CANDIDATES})")).alias("__e"), "__total")
        .select(F.col("__e.item").alias("__item"), "__total")
    )


def winners(rows: DataFrame) -> DataFrame:
    """(digest, size, last): exact sizes and last rows of the digests that hold a large share of all rows."""
    return (
        rows.withColumn("__item", F.xxhash64("__digest"))
        .join(F.broadcast(frequent(rows)), "__item")
        .groupBy("__digest")
        .agg(F.count("*").alias("__size"), F.max("__row").alias("__last"), F.first("__total").alias("__total"))
        .where(F.col("__size") * HEAVY_SHARE >= F.col("__total"))
        .select("__digest", "__size", "__last")
    )


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. In a group the largest id stays; null ids are smaller than any other. Of rows
    that repeat one id and text, exactly one is kept. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), digest(text_col).alias("__digest"))
    rows = stored(rows.withColumn("__tag", F.monotonically_increasing_id()), "exact-digests").withColumn("__row", F.struct("__id", "__tag"))
    heavy = stored(winners(rows), "exact-winners")
    tagged = rows.join(F.broadcast(heavy), "__digest", "left")
    rest = tagged.where(F.col("__last").isNull()).drop("__last", "__size")
    light = rest.join(rest.groupBy("__digest").agg(F.count("*").alias("__size"), F.max("__row").alias("__last")), "__digest")
    return (
        tagged.where(F.col("__last").isNotNull())
        .unionByName(light)
        .select(
            F.col("__id").alias(id_col),
            F.col("__last.__id").alias("keep_id"),
            F.col("__size").alias("group_size"),
            (F.col("__row.__tag") == F.col("__last.__tag")).alias("kept"),
            F.lower(F.hex("__digest")).alias("text_sha256"),
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; the same rules as mark_exact_duplicates.

    Winners are settled map-side: only the row with the winner's id goes on, and rows that repeat that id and
    text are pre-aggregated to one. The rest is ranked within its digest; each map task sends one row of a digest
    at most to that shuffle.
    """
    keyed = packed(docs, __digest=digest(text_col), __key=F.col(f"`{id_col}`"))
    rows = stored(keyed.select("__digest", F.struct(F.col("__key").alias("__id"), F.lit(0).alias("__tag")).alias("__row")), "exact-digests")
    heavy = stored(winners(rows), "exact-winners")
    tagged = keyed.join(F.broadcast(heavy), "__digest", "left")
    settled = (
        tagged.where(F.col("__last").isNotNull() & F.col("__key").eqNullSafe(F.col("__last.__id")))
        .groupBy("__digest")
        .agg(F.first("__doc").alias("__doc"))
    )
    order = Window.partitionBy("__digest").orderBy(F.col("__key").desc_nulls_last())
    light = tagged.where(F.col("__last").isNull()).withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
    return unpacked(settled.select("__doc").unionByName(light.select("__doc")))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
    AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
