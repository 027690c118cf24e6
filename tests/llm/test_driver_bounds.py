"""What comes to the driver doesn't grow with the partitions, and block pairs are dealt to groups of bounded size."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from sparkquill.llm import simhash, topk
from sparkquill.llm.common import stored
from tests.plans import broadcast_bytes

JOB = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[4]").config("spark.driver.maxResultSize", "6m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
         .config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.adaptive.enabled", "false").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
from sparkquill.llm import near_copies, token_counts, topk
rows = spark.range(0, 100_000, 1, 200).select(F.col("id").alias("__id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(64)).cast("double")).alias("__v"))
assert len(topk.pivots(rows, 300, 16)) == 300
print("pivots hold")
same = rows.select("__id", F.array([F.lit(1.0)] * 16).alias("__v")).withColumn("__id", F.lit(7))
assert len(topk.pivots(same, 300, 16)) == 1
near_copies.REPEATED, near_copies.SAMPLED = 5000, 1
texts = spark.range(0, 20_000, 1, 200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.floor(F.col("id") / (i + 2))) for i in range(14)]).alias("text"))
assert near_copies.prefixes(texts, "doc_id", "text")[0].count() == 20_000
print("repeated shingles hold")
units = texts.union(texts)
token_counts.SAMPLED, token_counts.TIER = 10**9, 3000
assert len(token_counts.frequent_units(units, "text")) == 3000
print("units hold")
"""


def test_collects_hold_with_200_partitions_and_a_small_result_size(tmp_path):
    """Three tables whose rows by partition, together, are over 6 MB: each bounded table comes to the driver all the same."""
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", JOB, f"file://{tmp_path}"], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split("\n")[:3] == ["pivots hold", "repeated shingles hold", "units hold"]


def test_block_pairs_are_dealt_to_small_groups(spark):
    """25 query blocks against 51 row blocks, one query block against 2,000: no group has many pairs, and every pair is in one group."""
    pairs = spark.createDataFrame([(q, r) for q in range(25) for r in range(51)] + [(99, r) for r in range(2000)], "q int, r int")
    for side, other in (("q", "r"), ("r", "q")):
        of, parts = topk.dealt(pairs, side, other, topk.TOGETHER)
        sizes = of.groupBy(side, "part").count()
        assert of.select("q", "r").distinct().count() == pairs.count() == of.count()
        assert sizes.agg(F.max("count")).first()[0] <= 4 * topk.TOGETHER
        assert of.join(parts, [side, "part"], "left_anti").count() == 0


def test_tried_chains_of_fingerprints_do_not_come_to_the_driver(spark):
    """Nodes of a small file are small to Spark after they are exploded too, 68 chains of each: 20,000 of them made a broadcast of 168 MB."""
    of = F.xxhash64(F.floor(F.col("id") / 2)).bitwiseXOR(F.when(F.col("id") < 200, F.col("id") % 2 * 5).otherwise(F.col("id") % 2 * -1))
    found = simhash.links(stored(spark.range(20_000).select(of.alias("__fp")), "nodes"))
    assert len(found.collect()) == 100
    assert broadcast_bytes(found._jdf.queryExecution().executedPlan()) < 1 << 20
