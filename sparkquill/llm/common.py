"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_fallback: dict[str, str] = {}
#: Tables that `stored` wrote, by application, until `release` removes them.
_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one if driver and tasks are one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        _fallback[key] = "file://" + tempfile.mkdtemp(prefix="sparkquill-")
    return _fallback[key]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage and is computed a single time.

    The table stays until `release`: results are lazy and read it when they are used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def held(spark: SparkSession) -> list[str]:
    """Paths of the tables that are stored now."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Removes stored tables (all of this application's, or those in `paths`); results that read them can't be used any more."""
    mine = _written.get(spark.sparkContext.applicationId, [])
    for path in list(mine) if paths is None else paths:
        if path in mine:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            mine.remove(path)


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """docs as one struct __doc, with columns of the operator's own beside it, so that no name of the caller's clashes with these."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), *[c.alias(name) for name, c in own.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    """The caller's columns of packed rows."""
    return rows.select("__doc.*")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that where every character is one byte."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def text_chunks(batches, max_bytes: int = 4 << 20, max_rows: int = 4096):
    """Cuts Arrow batches whose last column is text into slices of bounded size (one row at least)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + max_bytes, side="right"))
            to = min(max(to, at + 1), at + max_rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
