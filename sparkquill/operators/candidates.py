"""Candidate passages of a quote within its source: hits in their order, or the local list where there are none.

The local list is what a search without an index gives: a source of a few paragraphs whole and in its own order, a larger one by the words that are shared,
then by place. Paragraphs that share nothing fill a list up, the first of the source before the others, so that a list is only short where its source is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.functions import text as T
from sparkquill.functions.text import tokens
from sparkquill.functions.verdict_terms import RANK_SQL, tone
from sparkquill.operators.documents import paragraphs
from sparkquill.operators.retrieval import of_asked, scoped_bm25
from sparkquill.operators.search import cosine
from sparkquill.sources.tables import FINDINGS_SQL, findings, read, stored

QUERIES, SQL = {}, {}
# fixed values: passages that are aligned with a quote, and passages whose meaning is compared
ALIGNED, COMPARED = 24, 32
#: Parts that a source's paragraphs are cut down in first.
SALT = 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def first_of(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group: of each of SALT parts first, so that no task ranks a whole group."""
    part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALT)).alias("__part")
    cut = rows.select("*", part)
    for by in ([group, "__part"], [group]):
        cut = cut.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k)
    return cut.drop("__part").withColumnRenamed("__n", "nth")


def local_list(asked: DataFrame, held: DataFrame, k: int, small: int) -> DataFrame:
    """(q, para_id, overlap, nth) for asked (q, source_id, text) and paragraphs (source_id, para_id, text): k by shared words, then by place (para_id).

    Where a source has `small` paragraphs or fewer, all of them in their order. Words are those of small letters and digits, each once.
    """
    held = of_asked(asked, held)
    words = lambda rows, *c: rows.select(*c, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    met = words(asked, "q", "source_id").join(words(held, "source_id", "para_id"), ["source_id", "token"]).groupBy("q", "para_id").agg(F.count("*").alias("overlap"))
    # the first of a source stand for all that share nothing: no list has more of them than k
    opening = first_of(held.select("source_id", "para_id"), "source_id", ["para_id"], max(k, small)).drop("nth")
    filled = asked.select("q", "source_id").join(opening, "source_id").select("q", "para_id", F.lit(0).cast("bigint").alias("overlap"))
    both = met.unionByName(filled).groupBy("q", "para_id").agg(F.max("overlap").alias("overlap"))
    size = held.groupBy("source_id").agg(F.count("*").alias("size"))
    whole = asked.join(size, "source_id").select("q", (F.col("size") <= small).alias("whole"))
    listed = both.join(whole, "q").withColumn("by", F.when(F.col("whole"), 0).otherwise(-F.col("overlap")))
    return first_of(listed, "q", ["by", "para_id"], k).select("q", "para_id", "overlap", "nth")


def candidates(asked: DataFrame, held: DataFrame, k: int = ALIGNED) -> DataFrame:
    """(q, para_id, nth, found): the best hits of each quote in its source, in their order, or its local list where the search finds nothing.

    asked: q, source_id, text. held: source_id, para_id (which orders paragraphs), text. Null texts and quotes without words find nothing and have the local list; a quote of a
    source without paragraphs has no row.
    """
    own = stored(of_asked(asked, held), "sources")
    hits = first_of(scoped_bm25(asked, held, own), "q", [F.desc("score"), "para_id"], k).select("q", "para_id", "nth")
    hits = stored(hits, "hits")
    rest = asked.join(hits.select("q").distinct(), "q", "left_anti")
    none = local_list(rest, own, k, k).select("q", "para_id", "nth")
    return hits.withColumn("found", F.lit(True)).unionByName(none.withColumn("found", F.lit(False)))


def sourced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Passages as quotes of a document, and documents as sources of their lines; every third quote has no word that a text has."""
    k = F.col("item_id")
    asked = read(spark, d, "benchmark").select(k.alias("q"), (k * 3).alias("source_id"), F.when(k % 3 == 0, "#q# ###").otherwise(F.col("text")).alias("text"))
    held = paragraphs(read(spark, d, "documents"), "\n").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") * 100_000 + F.col("para_no")).alias("para_id"), "text")
    return asked, held


LIST_SQL = (
    r"""t AS (SELECT doc_id AS source_id, doc_id * 100000 + i AS para_id, regexp_extract_all(lower(p[i]), '[a-z0-9]+') AS t FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^"""
    + T.SPACE_SQL + "+|" + T.SPACE_SQL + """+$', '', 'g')), lambda x: x <> '') AS p FROM documents), unnest(range(1, len(p) + 1)) AS r(i)),
    q AS (SELECT item_id AS q, item_id * 3 AS source_id, CASE WHEN item_id % 3 = 0 THEN '#q# ###' ELSE text END AS text FROM benchmark),
    o AS (SELECT q, source_id, para_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), list_distinct(t))) AS overlap, count(*) OVER (PARTITION BY q) AS size FROM q JOIN t USING (source_id)),"""
)


@query(
    f"""WITH {LIST_SQL} w AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM t), u AS (SELECT source_id, para_id, len(t) AS l, unnest(t) AS token FROM t),
    tf AS (SELECT source_id, para_id, token, count(*) AS f, any_value(l) AS l FROM u GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    g AS (SELECT DISTINCT q, source_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM q),
    b AS (SELECT q, para_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM g JOIN tf USING (source_id, token) JOIN df USING (token), w GROUP BY ALL),
    h AS (SELECT q, para_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, para_id) AS nth FROM b),
    l AS (SELECT q, para_id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN size <= 24 THEN 0 ELSE -overlap END, para_id) AS nth FROM o WHERE q NOT IN (SELECT q FROM h))
    SELECT q, para_id, nth::INT AS nth, true AS found FROM h WHERE nth <= 24 UNION ALL SELECT q, para_id, nth::INT, false FROM l WHERE nth <= 24"""
)
def quote_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Hits within each quote's source, or the local list."""
    return candidates(*sourced(spark, d))


@query(f"WITH {LIST_SQL} l AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY overlap DESC, para_id) AS nth FROM o) SELECT q, para_id, overlap, nth::INT AS nth FROM l WHERE nth <= 32")
def semantic_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The passages whose meaning is compared: by shared words whatever the size of a source, those that share none among them."""
    return local_list(*sourced(spark, d), COMPARED, 0)


@query(f"""SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '{T.SPACE_SQL}+', ' ', 'g'))) AS form FROM documents""")
def citation_forms(spark: SparkSession, d: str) -> DataFrame:
    """Texts as citations are compared: casefolded, with single spaces."""
    return form_digests(read(spark, d, "documents").select("doc_id", "text"))


def form_digests(rows: DataFrame) -> DataFrame:
    """(key, form) of rows (key, text): the digest of each casefolded text. A task holds one text at a time besides its batch, and sends digests on only."""

    def digest(text):
        return None if text is None else hashlib.sha256(" ".join(text.casefold().split()).encode()).hexdigest()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(x.as_py()) for x in batch.column(1)], pa.string())], names)

    names = [rows.columns[0], "form"]
    return rows.mapInArrow(run, f"`{names[0]}` {rows.schema[0].dataType.simpleString()}, form string")


def matching(citations: DataFrame, found: DataFrame, check: Column, wanted: Column) -> DataFrame:
    """Citations that a filter shows: with one finding (citation_id, check, verdict) that is of the check and of the tone at once, `all` being any.

    A citation without findings is shown under all checks, as grey.
    """
    fits = ((check == "all") | (F.col("check") == check)) & ((wanted == "all") | (tone(F.col("verdict")) == wanted))
    each = found.groupBy("citation_id").agg(F.bool_or(fits).alias("fits"))
    bare = (check == "all") & ((wanted == "all") | (wanted == "grey"))
    return citations.join(each, "citation_id", "left").where(F.coalesce("fits", bare)).drop("fits")


# fixed values: filters that are shown
FILTERS = (("all", "all"), ("all", "grey"), ("quote", "all"), ("quote", "red"), ("existence", "grey"), ("all", "green"))


@query(
    f"""WITH {FINDINGS_SQL}, g AS (SELECT citation_id, "check", ['green','grey','yellow','red'][{RANK_SQL}] AS tone FROM f WHERE value > 60),
    p AS (SELECT * FROM (VALUES {", ".join(map(str, FILTERS))}) AS v(by_check, by_tone))
    SELECT by_check, by_tone, c_custkey AS citation_id FROM customer, p WHERE CASE WHEN c_custkey IN (SELECT citation_id FROM g)
      THEN EXISTS (SELECT 1 FROM g WHERE citation_id = c_custkey AND (by_check = 'all' OR "check" = by_check) AND (by_tone = 'all' OR tone = by_tone)) ELSE by_check = 'all' AND by_tone IN ('all', 'grey') END"""
)
def citation_filters(spark: SparkSession, d: str) -> DataFrame:
    """Which citations each filter shows, those without findings among them."""
    cites = read(spark, d, "customer").select(F.col("c_custkey").alias("citation_id"))
    found = findings(spark, d).where("value > 60")
    shown = [matching(cites, found, F.lit(c), F.lit(t)).select(F.lit(c).alias("by_check"), F.lit(t).alias("by_tone"), "citation_id") for c, t in FILTERS]
    out = shown[0]
    for more in shown[1:]:
        out = out.unionByName(more)
    return out


def closing_rows(citations: DataFrame) -> DataFrame:
    """(citation_id, check, verdict, note) of citations (citation_id, quote, reason) whose source can't be had.

    Each gets a proposition row with the reason; a quote row only those that quote something.
    """
    quoted = F.when(F.coalesce("quote", F.lit("")) != "", F.struct(F.lit("quote").alias("check"), F.lit("SOURCE_UNAVAILABLE").alias("verdict"), F.lit(None).cast("string").alias("note")))
    said = F.struct(F.lit("proposition").alias("check"), F.lit("UNVERIFIABLE").alias("verdict"), F.col("reason").alias("note"))
    return citations.select("citation_id", F.explode(F.array_compact(F.array(quoted, said))).alias("r")).select("citation_id", "r.*")


@query(
    """SELECT o_orderkey AS citation_id, 'proposition' AS "check", 'UNVERIFIABLE' AS verdict, CASE WHEN o_orderkey % 2 = 0 THEN 'SOURCE_UNAVAILABLE' ELSE 'NO_RETRIEVED_EVIDENCE' END AS note FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey, 'quote', 'SOURCE_UNAVAILABLE', NULL FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0"""
)
def unavailable_rows(spark: SparkSession, d: str) -> DataFrame:
    """Closing rows of orders without a source: some quote nothing, or an empty text."""
    k = F.col("o_orderkey")
    quote = F.when(k % 5 == 0, "").when(k % 3 != 0, F.concat(F.lit("q"), k))
    reason = F.when(k % 2 == 0, "SOURCE_UNAVAILABLE").otherwise("NO_RETRIEVED_EVIDENCE")
    return closing_rows(read(spark, d, "orders").where("o_orderstatus = 'P'").select(k.alias("citation_id"), quote.alias("quote"), reason.alias("reason")))


def label_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, errors) of files (path, text) of JSON: (brief, path, label) by the brief's name in small letters, the last path's for a name; and the paths that aren't label documents.

    A label document is an object with a text named brief. Errors come as rows, so that one bad file doesn't hide the others.
    """
    v = F.try_parse_json("text")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.brief", "variant"))
    good = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & (kind == "STRING"), F.lit(False))
    rows = files.select("path", "text", good.alias("good"), F.lower(F.try_variant_get(v, "$.brief", "string")).alias("brief"))
    labels = rows.where("good").groupBy("brief").agg(F.max("path").alias("path"), F.max_by("text", "path").alias("label"))
    return labels, rows.where(~F.col("good")).select("path", F.concat(F.lit("invalid evaluation label file: "), F.col("path")).alias("error"))


@query(
    """WITH f AS (SELECT doc_id, lpad(doc_id::VARCHAR, 9, '0') || '.json' AS path, 'brief ' || doc_id // 3 AS brief, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS good FROM labels)
    SELECT max(path) AS path, brief AS what FROM f WHERE good GROUP BY brief UNION ALL SELECT path, 'invalid evaluation label file: ' || path FROM f WHERE NOT good"""
)
def label_files(spark: SparkSession, d: str) -> DataFrame:
    """Label documents by brief, and beside them the error of each that is none: cut off, a list, or with a number for a name."""
    k = F.col("doc_id")
    name = F.concat(F.lit('"Brief '), F.floor(k / 3), F.lit('"'))
    text = F.concat(F.lit('{"brief": '), F.when(k % 13 == 0, "17").otherwise(name), F.lit(', "toxic": '), F.col("toxic"), F.when(k % 7 == 0, "").otherwise("}"))
    files = read(spark, d, "labels").select(F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit(".json")).alias("path"), F.when(k % 11 == 0, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text).alias("text"))
    labels, errors = label_documents(files)
    return labels.select("path", F.col("brief").alias("what")).unionByName(errors.select("path", F.col("error").alias("what")))


def stored_result(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """One row (name, value as JSON) for each field of the first of these files that exists, without the job references of its dataset; None where none exists.

    What isn't an object gives an error.
    """
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            fields = F.from_json("value", "map<string,variant>")
            rows = spark.read.text(path, wholetext=True).select(F.when(F.try_parse_json("value").isNull() | fields.isNull(), F.raise_error(F.lit("evaluation results are invalid"))).otherwise(fields).alias("f"))
            each = rows.select(F.explode("f").alias("name", "v")).withColumn("json", F.to_json("v"))
            kept = F.map_filter(F.from_json("json", "map<string,variant>"), lambda k, _: k != "job_references")
            return each.select("name", F.when((F.col("name") == "dataset") & F.startswith("json", F.lit("{")), F.to_json(kept)).otherwise(F.col("json")).alias("value"))
    return None


def checked_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; those of different sizes give an error, as they come from different models."""
    wrong = F.concat(F.lit("vectors of sizes "), F.size(a), F.lit(" and "), F.size(b))
    return F.when(F.size(a) != F.size(b), F.raise_error(wrong)).otherwise(cosine(a, b))


@query(
    """SELECT e.vec_id, round(coalesce(list_cosine_similarity(e.embedding::DOUBLE[], n.embedding::DOUBLE[]), 0), 4) AS score FROM embeddings e JOIN embeddings n ON n.vec_id = e.vec_id + 1"""
)
def neighbour_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector and the next one by id; sizes are checked row by row."""
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(checked_cosine(F.col("embedding"), F.col("other")), 4).alias("score"))
