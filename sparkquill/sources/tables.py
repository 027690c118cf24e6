"""Reads tables, and maps event rows to findings of checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: verdict of each event type, and check of each remainder
VERDICT_OF = {"click": "VERBATIM", "view": "ALTERED", "purchase": "VERIFIED", "signup": "PENDING", "error": "NOT_FOUND_IN_SOURCE"}
CHECKS = ("existence", "quote", "proposition")
#: Rows of a task on average, where rows are dealt by number.
EACH = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(n: int, each: int = EACH) -> int:
    """Partitions for n rows. Spark doesn't put partitions together whose number is given, so a task's rows, and its memory, don't grow with a table."""
    return max(1, -(-n // each))


def dealt(spark: SparkSession, sf_dir: str, table: str, key: str, cases, names: str, every: bool = False) -> DataFrame:
    """The rows of a table as cases: its key as `k`, and the fields of the case that the key's remainder names, or of each case with `every`.

    `{k}` in a text stands for the key, so that cases differ from row to row.
    """
    fixed = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "__case int, " + names)
    k = F.col(key)
    nth = F.explode(F.sequence(F.lit(0), F.lit(len(cases) - 1))) if every else F.pmod(k, F.lit(len(cases))).cast("int")
    keys = read(spark, sf_dir, table).select(k)
    parts = tasks(keys.count() * (len(cases) if every else 1))
    # a file may be one task's, so its keys are dealt before they multiply
    rows = (keys.repartition(parts, key) if parts > 1 else keys).select(k.alias("k"), nth.alias("__case"))
    fields = [F.replace(f.name, F.lit("{k}"), F.col("k").cast("string")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in fixed.schema[1:]]
    return rows.join(F.broadcast(fixed), "__case").select("k", *fields)


def dealt_sql(table: str, key: str, cases, names: str, every: bool = False) -> str:
    """SQL of the rows that `dealt` makes."""
    one = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    columns = names.split(", ")
    texts = {i for c in cases for i, x in enumerate(c) if isinstance(x, str)}
    shown = ", ".join(f"replace({c}, '{{k}}', {key}::VARCHAR) AS {c}" if i in texts else c for i, c in enumerate(columns))
    given = ", ".join("(" + ", ".join([str(i), *map(one, c)]) + ")" for i, c in enumerate(cases))
    return f"SELECT {key} AS k, {shown} FROM {table} JOIN (VALUES {given}) AS t(nth, {names}) ON " + ("true" if every else f"{key} % {len(cases)} = nth")


_folder: dict[str, str] = {}
#: Tables and streams that were written to the shared folder, by application, until `release` removes them.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one if driver and tasks are one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _folder:
        _folder[key] = "file://" + tempfile.mkdtemp(prefix="sparkquill-")
    return _folder[key]


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that `release` knows."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage and is computed a single time."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(spark: SparkSession) -> list[str]:
    """Paths that were written and are there still."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Removes what was written (all of this application's, or those in `paths`); results that read it can't be used any more."""
    mine = _written.get(spark.sparkContext.applicationId, [])
    for path in list(mine) if paths is None else paths:
        if path in mine:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            mine.remove(path)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: job, citation_id, check, verdict, seq, created."""
    verdict = F.create_map(*[F.lit(x) for pair in VERDICT_OF.items() for x in pair])
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("job"),
        F.col("user_id").alias("citation_id"),
        F.element_at(F.array(*map(F.lit, CHECKS)), (k % 3 + 1).cast("int")).alias("check"),
        verdict[F.col("event_type")].alias("verdict"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("created"),
        "value",
    )


FINDINGS_SQL = """f AS (SELECT user_id % 10 AS job, user_id AS citation_id,
  CASE CAST(json_extract_string(props, '$.k') AS INT) % 3 WHEN 0 THEN 'existence' WHEN 1 THEN 'quote' ELSE 'proposition' END AS "check",
  CASE event_type WHEN 'click' THEN 'VERBATIM' WHEN 'view' THEN 'ALTERED' WHEN 'purchase' THEN 'VERIFIED'
    WHEN 'signup' THEN 'PENDING' ELSE 'NOT_FOUND_IN_SOURCE' END AS verdict, event_id AS seq, ts AS created, value FROM events)"""
