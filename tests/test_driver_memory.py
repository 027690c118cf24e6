"""Tables that are small as files and large as rows stay out of the driver's memory."""

from pyspark.sql import functions as F

from sparkquill.operators import citations
from tests.plans import broadcast_bytes


def test_citations_with_repeated_texts_are_not_broadcast(spark):
    """100,000 citations whose texts repeat are a file of 1 MB or less, by which Spark would send their rows to the driver."""
    kinds = [("full", "Roe v. Wade", "Roe v. Wade, 410 U.S. 113"), ("short", "Roe", "Roe, 410 U.S. at 120"), ("id", None, "Id. at 121"), ("supra", "Roe", "Roe, supra, at 122"), ("short", None, "410 U.S. at 123")]
    fixed = spark.createDataFrame([(i + 1, *k, *(("410", "U.S.") if k[0] in ("full", "short") else (None, None))) for i, k in enumerate(kinds)], "n int, kind string, name string, raw_text string, volume string, reporter string")
    cites = spark.range(20_000).select(F.concat(F.lit("brief "), "id").alias("doc_id")).crossJoin(F.broadcast(fixed))
    found = citations.antecedents(cites).groupBy("n", "root").count()
    assert {(r.n, r.root): r["count"] for r in found.collect()} == {(1, None): 20_000, (2, 1): 20_000, (3, 1): 20_000, (4, 1): 20_000, (5, 1): 20_000}
    assert broadcast_bytes(found._jdf.queryExecution().executedPlan()) < 1 << 20
