"""Paragraph rows and retrieval within a source: lexical and vector lists, fusion, a reranker's order with its fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.functions.text import strip, tokens
from sparkquill.operators.search import K1, B, cosine, fuse, token_counts
from sparkquill.sources.tables import dealt, dealt_sql, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vector_of(vector: Column, size: int) -> Column:
    """A vector of this size without null or non-finite components; null otherwise, so that its paragraph is found by words alone."""
    sound = (F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(sound, vector)


def paragraph_rows(rows: DataFrame, size: int) -> DataFrame:
    """(para_id, source_id, para_no, opinion_part, text, embedding) of rows (source_id, para_no, part, text, embedding); one for each source and number.

    The id is `source:pN`. Rows without a source, with a number under 1 or with a blank text are no paragraphs. An opinion part that isn't
    told is unknown. Of rows that repeat an id, the one of the least text stays.
    """
    good = rows.where(F.col("source_id").isNotNull() & (F.col("para_no") >= 1) & (strip(F.col("text")) != ""))
    para = F.concat(F.col("source_id").cast("string"), F.lit(":p"), F.col("para_no").cast("string"))
    row = F.struct("text", F.coalesce("part", F.lit("unknown")).alias("opinion_part"), vector_of(F.col("embedding"), size).alias("embedding"))
    return good.groupBy("source_id", "para_no", para.alias("para_id")).agg(F.min(row).alias("r")).select("para_id", "source_id", "para_no", "r.*")


def of_asked(asked: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The paragraphs of sources that a query asks."""
    return paragraphs.join(asked.select("source_id").distinct(), "source_id", "left_semi")


def scoped_bm25(asked: DataFrame, paragraphs: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(q, para_id, score): paragraphs of the query's own source that share a token with it; counts of documents are those of all sources.

    asked: q, source_id, text. own: `of_asked`, where it is there already. Source and token are the key of one equi-join, which only asked sources come to; of the others
    tokens are counted in the tasks before they are shuffled.
    """
    words = lambda rows: rows.select("source_id", "para_id", tokens(F.col("text")).alias("t"))
    tf = words(of_asked(asked, paragraphs) if own is None else own).select("source_id", "para_id", F.size("t").alias("len"), F.explode("t").alias("token"))
    tf = tf.groupBy("source_id", "para_id", "token").agg(F.count("*").alias("f"), F.first("len").alias("len"))
    stats, df = token_counts(words(paragraphs))
    want = asked.select("q", "source_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    met = want.join(tf, ["source_id", "token"]).join(df, "token").join(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return met.groupBy("q", "para_id").agg(F.round(F.sum(part), 6).alias("score"))


def scoped_knn(asked: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(q, para_id, score): cosine with the paragraphs of the query's own source; queries and paragraphs without a vector have none. asked: q, source_id, vector."""
    held = paragraphs.where(F.col("embedding").isNotNull()).select("source_id", "para_id", "embedding")
    both = asked.where(F.col("vector").isNotNull()).select("q", "source_id", "vector").join(held, "source_id")
    return both.select("q", "para_id", F.round(cosine(F.col("vector"), F.col("embedding")), 6).alias("score"))


def top(rows: DataFrame, k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "para_id"))
    return rows.withColumn("rank", n).where(F.col("rank") <= k).select("q", "para_id", "rank")


def safe_order(fused: DataFrame, reranked: DataFrame) -> DataFrame:
    """(q, para_id, pos): a reranker's order (q, para_id, nth) over the fused list (q, para_id, pos), then the rest in their order.

    Paragraphs that were not given to it, and repeats after the first, are passed over; a query without an answer keeps its order.
    """
    given = reranked.groupBy("q", "para_id").agg(F.min("nth").alias("nth"))
    order = Window.partitionBy("q").orderBy(F.asc_nulls_last("nth"), "pos")
    return fused.join(given, ["q", "para_id"], "left").select("q", "para_id", F.row_number().over(order).alias("pos"))


def retrieve(asked: DataFrame, paragraphs: DataFrame, k: int, reranked: DataFrame | None = None) -> DataFrame:
    """(q, para_id, pos): the k paragraphs of each query's source by rank fusion of words and vectors, reranked if there are answers.

    Queries without a source or with a blank text find nothing; those without a vector are answered by words alone.
    """
    if k <= 0:
        return asked.limit(0).select("q", F.lit("").alias("para_id"), F.lit(0).alias("pos"))
    asked = asked.where(F.col("source_id").isNotNull() & (strip(F.col("text")) != ""))
    lists = top(scoped_bm25(asked, paragraphs), k).unionByName(top(scoped_knn(asked, paragraphs), k))
    fused = fuse(lists, "q", "para_id", k).select("q", "para_id", "pos")
    return fused if reranked is None else safe_order(fused, reranked)


LETTERS = "etaoinsr"
VECTOR_SQL = "[" + ", ".join(f"(length(text) - length(replace(text, '{x}', '')))::DOUBLE" for x in LETTERS) + "]"


def letter_counts(text: Column) -> Column:
    """A small vector that follows from a text itself: how often each of some letters is there."""
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))).cast("double") for x in LETTERS])


TURNS_SQL = f"""t AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 5 <> 4 THEN {VECTOR_SQL} END AS e FROM conversations),
    a AS (SELECT conv_id AS q, text, e FROM t WHERE turn = 0 AND trim(text) <> ''),
    p AS (SELECT conv_id, conv_id || ':p' || turn AS para_id, text, e FROM t WHERE turn >= 1 AND trim(text) <> ''),
    w AS (SELECT conv_id, para_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM p),
    st AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM w),
    tf AS (SELECT conv_id, para_id, token, count(*) AS f, any_value(l) AS l FROM (SELECT conv_id, para_id, len(t) AS l, unnest(t) AS token FROM w) GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    qt AS (SELECT DISTINCT q, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM a),
    bm AS (SELECT q, para_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
      FROM qt JOIN tf ON tf.token = qt.token AND conv_id = q JOIN df ON df.token = qt.token, st GROUP BY q, para_id),
    kn AS (SELECT q, para_id, round(CASE WHEN list_sum(list_transform(a.e, lambda x: x * x)) = 0 OR list_sum(list_transform(p.e, lambda x: x * x)) = 0 THEN 0
      ELSE list_cosine_similarity(a.e, p.e) END, 6) AS score FROM a JOIN p ON conv_id = q WHERE a.e IS NOT NULL AND p.e IS NOT NULL),
    l AS (SELECT q, para_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, para_id) AS rank FROM bm
      UNION ALL SELECT q, para_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, para_id) FROM kn),
    s AS (SELECT q, para_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS first FROM l WHERE rank <= 4 GROUP BY ALL),
    f AS (SELECT q, para_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, first, para_id) AS pos FROM s)"""


def turns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(queries, paragraphs): the first turn of each conversation, and its other turns as paragraphs of a source; a fifth of them has no vector."""
    rows = read(spark, d, "conversations").withColumn("v", F.when(F.col("turn") % 5 != 4, letter_counts(F.col("text"))))
    asked = rows.where("turn = 0").select(F.col("conv_id").alias("q"), F.col("conv_id").alias("source_id"), "text", F.col("v").alias("vector"))
    held = rows.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("para_no"), F.lit(None).cast("string").alias("part"), "text", F.col("v").alias("embedding"))
    return asked, paragraph_rows(held, len(LETTERS))


@query(f"WITH {TURNS_SQL} SELECT q, para_id, pos FROM f WHERE pos <= 4")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    asked, held = turns(spark, d)
    return retrieve(asked, held, 4)


@query(
    f"""WITH {TURNS_SQL}, k AS (SELECT * FROM f WHERE pos <= 4),
    r AS (SELECT conv_id AS q, para_id, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, para_id) AS nth FROM p WHERE conv_id % 3 <> 0 AND length(text) % 2 = 0)
    SELECT k.q, k.para_id, row_number() OVER (PARTITION BY k.q ORDER BY nth NULLS LAST, pos) AS pos FROM k LEFT JOIN r ON r.q = k.q AND r.para_id = k.para_id"""
)
def hybrid_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The same with a reranker that prefers long texts, answers some paragraphs only, names others that it was not given, and fails for a third of the queries."""
    asked, held = turns(spark, d)
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc(F.length("text")), "para_id"))
    answers = held.where((F.col("source_id") % 3 != 0) & (F.length("text") % 2 == 0)).select(F.col("source_id").alias("q"), "para_id", nth.alias("nth"))
    return retrieve(asked, held, 4, answers)


@query("SELECT conv_id || ':p' || turn AS para_id, conv_id AS source_id, turn AS para_no, 'unknown' AS opinion_part, turn % 5 <> 4 AS has_vector FROM conversations WHERE turn >= 1 AND trim(text) <> ''")
def paragraph_index(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d)[1].select("para_id", "source_id", "para_no", "opinion_part", F.col("embedding").isNotNull().alias("has_vector"))


@query(dealt_sql("customer", "c_custkey", [("p3", 1), ("p1", 2), ("p2", 3), ("p4", 4)], "para_id, pos", every=True))
def rerank_safe_order(spark: SparkSession, d: str) -> DataFrame:
    """A reranker's order over known ids, then the rest in their order; unknown and repeated ids are passed over."""
    known = dealt(spark, d, "customer", "c_custkey", [("p1", 1), ("p2", 2), ("p3", 3), ("p4", 4)], "para_id string, pos int", every=True).withColumnRenamed("k", "q")
    given = dealt(spark, d, "customer", "c_custkey", [("p3", 1), ("zz", 2), ("p1", 3), ("p3", 4)], "para_id string, nth int", every=True).withColumnRenamed("k", "q")
    return safe_order(known, given).select(F.col("q").alias("k"), "para_id", "pos")
