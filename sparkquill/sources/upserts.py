"""Upserts into a stored table that is cut into buckets by its keys.

A batch is merged with the buckets that its keys fall into, and only these are written anew. A row has the order of its first and of its last write; the
merge takes the least and the greatest of these, so that a batch that comes twice, late or after a failure leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.operators.findings import stamp
from sparkquill.sources.tables import FINDINGS_SQL, findings, own_path, stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Upserts:
    """A table at `path` with one row for each key: columns `latest` of its last write by `order`, columns `first` of its first.

    Null keys are keys. Writes of the same order of a key are the same write. The number of buckets is fixed when the table is made; choose it so that
    a bucket is a task's work.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, latest: list[str], first: list[str], buckets: int):
        self.spark, self.path, self.keys, self.order, self.latest, self.first, self.buckets = spark, path, keys, order, latest, first, buckets

    def one_each(self, rows: DataFrame) -> DataFrame:
        """Rows (keys, new, old) with one for each key; partial on the map side, so a key with most of the writes costs one row a task."""
        return rows.groupBy("bucket", *self.keys).agg(F.max_by("new", "new.at").alias("new"), F.min_by("old", "old.at").alias("old"))

    def merge(self, batch: DataFrame) -> list[int]:
        """Merges a batch and gives the numbers of the buckets that it wrote, `buckets` at most."""
        bucket = F.pmod(F.xxhash64(*self.keys, *[F.col(k).isNull() for k in self.keys]), F.lit(self.buckets)).cast("int")
        at = F.col(self.order).alias("at")
        rows = batch.where(F.col(self.order).isNotNull()).select(bucket.alias("bucket"), *self.keys, F.struct(at, *self.latest).alias("new"), F.struct(at, *self.first).alias("old"))
        fresh = stored(self.one_each(rows), "upsert-batch")
        touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())
        if not touched:
            return []
        there = self.stored_rows(fresh.schema)
        both = fresh if there is None else fresh.unionByName(there.where(F.col("bucket").isin(touched)))
        # the merged rows are written elsewhere first: a lost executor can't find its input half replaced
        merged = stored(self.one_each(both), "upsert-merged")
        out = merged.repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("bucket").parquet(self.path)
        return touched

    def stored_rows(self, schema) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(schema).parquet(self.path).select(*schema.names)

    def rows(self, schema) -> DataFrame:
        """The table: keys, columns of the last and of the first write."""
        found = self.stored_rows(schema)
        return found.select(*self.keys, *[F.col(f"new.{c}").alias(c) for c in self.latest], *[F.col(f"old.{c}").alias(c) for c in self.first])

    def schema(self, batch: DataFrame):
        """The schema of the stored rows of such batches."""
        at = F.col(self.order).alias("at")
        return batch.limit(0).select(F.lit(0).cast("int").alias("bucket"), *self.keys, F.struct(at, *self.latest).alias("new"), F.struct(at, *self.first).alias("old")).schema


@query(
    f"""WITH {FINDINGS_SQL} SELECT citation_id, "check", max_by(verdict, seq) AS verdict, max_by(value, seq) AS value,
    strftime(min_by(created, seq), '%Y-%m-%d %H:%M:%S') AS created FROM f GROUP BY citation_id, "check" """
)
def stored_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings as a stored table that three batches of events were merged into, the middle one first and twice."""
    rows = findings(spark, d).select("citation_id", "check", "verdict", "value", "created", "seq")
    table = Upserts(spark, own_path(spark, "findings"), ["citation_id", "check"], "seq", ["verdict", "value"], ["created"], 16)
    for part in (1, 0, 1, 2):
        table.merge(rows.where(F.col("seq") % 3 == part))
    return table.rows(table.schema(rows)).withColumn("created", stamp("created"))
