"""Quality classifier by hierarchical empirical Bayes.

A logistic classifier over statistics of the whole text gives each document's evidence. Expected good documents are
summed by host and by path under it (grouped aggregation); the shrinkage of hosts toward the global rate, and of paths toward
their host, is fitted to the spread between groups by the method of moments. A document's log-odds are its own
evidence plus what its path's posterior, made from the other documents there, adds to the global rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import stored, table, text_chunks

#: Labelled documents that the classifier is fitted to: those with the least hash of their id.
SAMPLE = 4000
SYMBOLS = b"#$%&*+<=>@\\^_`{|}~[]/"
#: Least and largest weight of a prior, in documents.
WEIGHTS = (2.0, 1000.0)
GOOD = 0.5
#: A site with a HOT-th of all rows is met by broadcast.
HOT = 500
FEATURES = 14


def features(text: str | None) -> list[float]:
    """Statistics of one whole text; zeros if it is null or blank."""
    import math

    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (text or "").split()
    if not words:
        return [0.0] * FEATURES
    size, n = len(raw), len(words)

    def share(kind: bytes) -> float:
        return (size - len(raw.translate(None, kind))) / size

    lines = [x for x in (text or "").split("\n") if x.strip()]
    upper, lower = share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"abcdefghijklmnopqrstuvwxyz")
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    return [
        1.0,
        math.log1p(n),
        share(SYMBOLS),
        share(b"|") * 10,
        share(b"0123456789"),
        upper,
        lower,
        share(b"!?") * 10,
        share(b".,") * 10,
        share(b"\n") * 10,
        math.log1p(size / n),
        len(set(words)) / n,
        repeats,
        1 - len(set(lines)) / len(lines),
    ]


def fit(x, y, rounds: int = 25, ridge: float = 1e-3):
    """Logistic regression by Newton's method on standardised features; (weights, intercept) for raw ones."""
    import numpy as np

    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + ridge * w
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """(weights, intercept) from SAMPLE labelled documents whose crc32 of the id mod 3 isn't 1; None if there are none.

    Rows that repeat an id count as one, with the least statistics of theirs, so SAMPLE rows of FEATURES numbers come to the driver at most.
    """
    import numpy as np

    label, key = F.col(f"`{label_col}`"), F.col(f"`{id_col}`")
    chosen = (
        labels.where(label.isNotNull() & (F.crc32(key.cast("string")) % 3 != 1))
        .groupBy(key.alias("__id"))
        .agg((F.avg(label) >= 0.5).cast("double").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(SAMPLE)
    )
    # at most SAMPLE ids
    texts = docs.select(key.alias("__key"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(chosen), F.col("__key") == F.col("__id"))
    texts = texts.select(F.xxhash64("__key").alias("__h"), "__y", "__text")
    kept = "h bigint, y double, x array<double>"

    def run(batches):
        import pyarrow as pa

        for part in text_chunks(batches):
            found = [features(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.float64()))], ["h", "y", "x"])

    once = texts.mapInArrow(run, kept).groupBy("h").agg(F.min(F.struct("y", "x")).alias("r")).select("r.y", "r.x")
    rows = sorted((r[0], r[1]) for r in once.collect())
    if not rows:
        return None
    return fit(np.array([r[1] for r in rows]), np.array([r[0] for r in rows]))


def evidence(docs: DataFrame, model, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """(__id, __host, __path, __z): the classifier's log-odds of each whole text."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, host_col, path_col)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in text_chunks(batches):
            x = np.array([features(t) for t in part.column(3).to_pylist()])
            z = np.clip(x @ model[0] + model[1], -12, 12) if model else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(z)], ["__id", "__host", "__path", "__z"])

    rows = docs.select(*[F.col(f"`{c}`") for c in (id_col, host_col, path_col, text_col)])
    return rows.mapInArrow(run, f"__id {kinds[0]}, __host {kinds[1]}, __path {kinds[2]}, __z double")


def strength(n: Column, k: Column, rate: Column) -> Column:
    """Weight of the prior in documents, by moments: what the spread between groups leaves over chance."""
    chance = rate * (1 - rate)
    between = F.sum(n * (k / n - rate) * (k / n - rate)) / F.sum(n) - F.sum(chance) / F.sum(n)
    ratio = F.avg(chance) / F.greatest(between, F.lit(1e-9)) - 1
    return F.least(F.greatest(ratio, F.lit(WEIGHTS[0])), F.lit(WEIGHTS[1]))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang"
) -> DataFrame:
    """One row per input row: id, evidence, host_posterior, path_posterior, score, good.

    Rates are rounded to 6 digits. Null hosts or paths are groups of their own. Null and blank texts have the
    evidence that the classifier gives to all-zero statistics; without labels all evidence is 0. Null ids and repeated
    rows keep their rows; an empty table gives none.
    """
    model = train(docs, labels, id_col, text_col)
    rows = stored(evidence(docs, model, id_col, text_col, host_col, path_col), "evidence").withColumn(
        "__p", 1 / (1 + F.exp(-F.col("__z")))
    )
    # sums of partial aggregates; a host with a third of all rows is a single row after the map side
    paths = stored(rows.groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("__p").alias("k")), "path-rates")
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    total = hosts.agg(F.sum("hn"), F.sum("hk")).first()
    rate = min(max((total[1] or 0.0) / (total[0] or 1), 1e-4), 1 - 1e-4)
    h_weight = hosts.agg(strength(F.col("hn"), F.col("hk"), F.lit(rate))).first()[0] or WEIGHTS[0]
    shrunk = hosts.withColumn("host_rate", (F.col("hk") + h_weight * rate) / (F.col("hn") + h_weight)).withColumnRenamed(
        "__host", "s_host"
    )
    named = paths.toDF("g_host", "g_path", "n", "k")
    both = named.join(shrunk, F.col("g_host").eqNullSafe(F.col("s_host")))
    p_weight = both.agg(strength(F.col("n"), F.col("k"), F.col("host_rate"))).first()[0] or WEIGHTS[0]
    same = F.col("__host").eqNullSafe(F.col("g_host")) & F.col("__path").eqNullSafe(F.col("g_path"))
    # at most HOT sites hold a HOT-th of all rows: these are broadcast and their rows aren't shuffled
    few = F.broadcast(both.where(F.col("n") * HOT >= F.lit(total[0] or 0)))
    crowded = rows.join(few, same)
    others = crowded.unionByName(rows.join(few, same, "left_anti").join(both, same))
    host = (F.col("hk") - F.col("__p") + h_weight * rate) / (F.col("hn") - 1 + h_weight)
    path = (F.col("k") - F.col("__p") + p_weight * F.col("host")) / (F.col("n") - 1 + p_weight)

    def odds(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.log(q / (1 - q))

    z = F.col("__z") + odds(F.col("path")) - odds(F.lit(rate))
    return (
        others.withColumn("host", host)
        .withColumn("path", path)
        .select(
            F.col("__id").alias(id_col),
            F.round("__z", 6).alias("evidence"),
            F.round("host", 6).alias("host_posterior"),
            F.round("path", 6).alias("path_posterior"),
            F.round(1 / (1 + F.exp(-z)), 6).alias("score"),
        )
        .withColumn("good", F.col("score") >= GOOD)
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
