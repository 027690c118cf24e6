"""Lexical and vector search, rank fusion, rerank order, retrieval metrics. Scores are rounded before they order rows."""

from __future__ import annotations

from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.functions.text import tokens
from sparkquill.sources.tables import read, stored, tasks

QUERIES, SQL = {}, {}
# fixed values: BM25 constants, constant of the rank fusion
K1, B, FUSION = 1.2, 0.75, 60


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ranked(rows: DataFrame, group: list[str], score: str, tie: str, k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", n).where(F.col("rank") <= k)


def token_counts(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stats, df) of texts as tokens t: one row of n_docs and their mean length, and in how many a token is. Texts are gone over once: a null token stands for
    each text, and tokens are counted in the tasks before they are shuffled."""
    none = F.lit(None).cast("string")
    own = F.array_append(F.coalesce(F.array_distinct("t"), F.array().cast("array<string>")), none)
    counts = words.select(F.size("t").alias("len"), F.explode(own).alias("token")).groupBy("token").agg(F.count("*").alias("df"), F.avg(F.when(F.col("token").isNull(), F.col("len"))).alias("mean"))
    counts = stored(counts, "tokens")
    return counts.where("token is null").select(F.col("df").alias("n_docs"), "mean"), counts.where("token is not null").select("token", "df")


#: Texts of a part, queries of a block that meets it, and texts and queries whose scores are a tile.
TEXTS, ASKERS, TILE = 4096, 16384, 256


def best(queries: DataFrame, corpus: DataFrame, q_id: str, c_id: str, lexical: int = 0, shared: int = 0, text: str = "text") -> DataFrame:
    """(by, q_id, c_id, score, overlap): of the texts that share a token with a query, those of each part that may be among its first `lexical` by BM25
    (by: score), and among its first `shared` by tokens that both have (by: overlap).

    Texts are dealt to parts by hashes and meet blocks of queries there, by products of matrices over the queries' tokens. All pairs are scored, but
    only what a query keeps of each part is shuffled by query.
    """
    asked = queries.select(F.col(q_id).alias("q"), F.explode(tokens(F.col(text))).alias("token")).distinct()
    words = corpus.select(F.col(c_id).alias("c"), tokens(F.col(text)).alias("t"))
    known = asked.select("*", F.lit(0.0).alias("idf"), F.lit(1.0).alias("mean"))
    if lexical:
        # one row of statistics, broadcast
        stats, df = token_counts(words)
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = asked.join(df, "token").join(F.broadcast(stats)).select("q", "token", idf.alias("idf"), "mean")
    n, m = tasks(queries.count(), ASKERS), tasks(corpus.count(), TEXTS)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    lists = known.select("*", F.pmod(F.xxhash64("q"), F.lit(n)).cast("int").alias("block"), each(m).alias("part"))
    held = words.where("size(t) > 0").select("c", F.array_join("t", " ").alias("t"), F.pmod(F.xxhash64("c"), F.lit(m)).cast("int").alias("part"), each(n).alias("block"))
    q_kind, c_kind = queries.schema[q_id].dataType.simpleString(), corpus.schema[c_id].dataType.simpleString()
    schema = f"by string, q {q_kind}, c {c_kind}, score double, overlap bigint"
    kinds = arrow_schema(schema)

    def run(asked, held):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not asked.num_rows or not held.num_rows:
            return kinds.empty_table()
        lists = pc.split_pattern(held["t"].combine_chunks(), " ")
        sizes = pc.list_value_length(lists).to_numpy()
        # rows of a text's id are one text; in order of ids, so that the first of equal ones is the lesser
        ids, row = np.unique(held["c"].to_numpy(), return_inverse=True)
        size, flat, of = np.bincount(row, sizes, len(ids)), lists.flatten(), np.repeat(row, sizes)
        every, nth = np.unique(asked["q"].to_numpy(), return_inverse=True)
        tokens, idf, mean = asked["token"].combine_chunks(), asked["idf"].to_numpy(), asked["mean"][0].as_py()
        out = []
        for lo in range(0, len(every), TILE):
            q, some = every[lo : lo + TILE], np.flatnonzero((nth >= lo) & (nth < lo + TILE))
            n, coded = len(q), tokens.take(pa.array(some)).dictionary_encode()
            weight, there = np.zeros((len(coded.dictionary), n)), np.zeros((len(coded.dictionary), n), np.float32)
            at = coded.indices.to_numpy(), nth[some] - lo
            weight[at], there[at] = idf[some], 1
            met = pc.index_in(flat, value_set=coded.dictionary)
            mine = met.is_valid().to_numpy(zero_copy_only=False)
            codes, f = np.unique(of[mine] * len(weight) + met.drop_null().to_numpy().astype(np.int64), return_counts=True)
            doc, word = codes // max(1, len(weight)), codes % max(1, len(weight))
            part = f * (K1 + 1) / (f + K1 * (1 - B + B * size[doc] / mean))
            score, overlap = np.zeros((n, len(ids))), np.zeros((n, len(ids)), np.float32)
            for first in range(0, len(ids), TILE):
                a, b = np.searchsorted(doc, [first, first + TILE])
                dense = np.zeros((min(TILE, len(ids) - first), len(weight)))
                dense[doc[a:b] - first, word[a:b]] = part[a:b]
                if lexical:
                    score[:, first : first + TILE] = (dense @ weight).T
                overlap[:, first : first + TILE] = ((dense > 0).astype(np.float32) @ there).T
            may = overlap > 0
            score = settled(score.ravel()).reshape(score.shape) if lexical else score
            for by, values, k in (("score", score, lexical), ("overlap", overlap, shared)):
                if k:
                    i, j = np.nonzero(greatest(values, may, k))
                    out.append(pa.table({"by": [by] * len(i), "q": q[i], "c": ids[j], "score": score[i, j], "overlap": overlap[i, j].astype(np.int64)}).cast(kinds))
        return pa.concat_tables(out)

    # with a number of tasks given, small parts aren't put together
    deal = lambda df: df.repartition(min(2 * n * m, 4096), "block", "part").groupBy("block", "part")
    return deal(lists).cogroup(deal(held)).applyInArrow(run, schema).withColumnsRenamed({"q": q_id, "c": c_id})


BM25_SQL = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
  st AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM w),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
  tf AS (SELECT doc_id, token, count(*) AS f, any_value(l) AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS token FROM w) GROUP BY doc_id, token),
  df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  bm AS (SELECT item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
    FROM q JOIN df USING (token) JOIN tf USING (token), st GROUP BY item_id, doc_id),
  lex AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""


def lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    found = best(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "doc_id", lexical=k)
    return ranked(found.select("item_id", "doc_id", "score"), ["item_id"], "score", "doc_id", k)


@query(f"WITH {BM25_SQL} SELECT item_id, doc_id, round(score, 4) AS score, rank FROM lex WHERE rank <= 6")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d, 6).withColumn("score", F.round("score", 4))


@query(
    """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
    p AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents),
    o AS (SELECT item_id, doc_id, len(list_intersect(q.t, p.t)) AS overlap FROM q, p),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS pos FROM o WHERE overlap > 0)
    SELECT item_id, doc_id, overlap, pos FROM r WHERE pos <= 24"""
)
def token_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 24 texts that share most distinct words with each passage."""
    found = best(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "doc_id", shared=24)
    return ranked(found.select("item_id", "doc_id", "overlap"), ["item_id"], "overlap", "doc_id", 24).withColumnRenamed("rank", "pos")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


COS_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  cs AS (SELECT q.vec_id AS q, c.vec_id AS c, q.label = c.label AS relevant, round(coalesce(list_cosine_similarity(q.e, c.e), 0), 6) AS score,
    round(-list_distance(q.e, c.e), 6) AS other FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
  sem AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM cs)"""
#: Queries and rows of a block, and pairs that are scored at once.
ASKED, HELD, AT_ONCE = 4096, 4096, 1 << 18


def micro(x):
    """Rounded to six places, halves away from 0."""
    import numpy as np

    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x) / 1e6 + 0.0


def settled(x):
    """As `micro`, but by the decimal digits where a value is about halfway."""
    import numpy as np

    out, near = micro(x), np.abs(np.abs(x) * 1e6 % 1 - 0.5) < 1e-4
    for i in np.flatnonzero(near):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
    return out


def similarities(q, e):
    """(cosine, distance with a minus) of all rows of two matrices, rounded to six places as sums in the order of components are.

    A matrix product is right but for its last digits; where these could change the rounded value, a pair is summed in order.
    """
    import numpy as np

    in_order = lambda x: np.add.accumulate(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))
    with np.errstate(all="ignore"):
        qs, es, off = in_order(q * q), in_order(e * e), (q.shape[1] + 8) * 1e-15
        dot, norms = q @ e.T, np.sqrt(qs)[:, None] * np.sqrt(es)[None, :]
        cos = dot / norms
        score, other = micro(cos - off), micro(cos + off)
        unsure = (score != other) & (norms != 0)
        score[norms == 0] = 0.0
        i, j = np.nonzero(unsure)
        for n in range(0, len(i), HELD):
            a, b = i[n : n + HELD], j[n : n + HELD]
            score[a, b] = settled(in_order(q[a] * e[b]) / norms[a, b])
        both = qs[:, None] + es[None, :]
        apart = both - 2 * dot
        other, high = micro(np.sqrt(np.maximum(apart - off * both, 0))), micro(np.sqrt(apart + off * both))
        i, j = np.nonzero(other != high)
        for n in range(0, len(i), HELD):
            a, b = i[n : n + HELD], j[n : n + HELD]
            other[a, b] = settled(np.sqrt(in_order((q[a] - e[b]) ** 2)))
    return score, 0.0 - other


def greatest(x, may, k: int):
    """Mask of the k greatest values of each row among those that may be taken, the earlier of equal ones first; NaN is greatest."""
    import numpy as np

    x = np.where(may, np.where(np.isnan(x), np.inf, x), -np.inf)
    at = max(0, x.shape[1] - k)
    least = np.partition(x, at, axis=1)[:, at : at + 1]
    over, same = (x > least) & may, (x == least) & may
    return over | same & (np.cumsum(same, axis=1) <= k - over.sum(axis=1, keepdims=True))


def vectors(column):
    """(matrix, mask of rows that have a whole vector): rows without, with a null in it or of a length that most others don't have are zeros."""
    import numpy as np

    sizes = [-1 if v is None else len(v) for v in column]
    size = Counter(n for n in sizes if n >= 0).most_common(1)
    size = size[0][0] if size else 0
    out, whole = np.zeros((len(sizes), size)), np.array([n == size for n in sizes], dtype=bool)
    for i in np.flatnonzero(whole):
        out[i] = column[i]
    return out, whole


def arrow_schema(columns: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(columns))


def met(spark: SparkSession, d: str, found, schema: str, known: DataFrame | None = None) -> DataFrame:
    """What `found(asked, held, score, other, may, lost)` gives for tiles of pairs of a query and a row: columns of `schema`.

    Queries are the rows whose id is divisible by 100; `asked` has q, ql and the columns of `known` (by q), `held` has c and label in order of c, score and
    other are matrices of rounded cosines and distances with a minus, `may` is false for a query's own rows. A row without a vector is lost: it has the cosine 0 and no distance.

    Queries and rows are dealt to blocks by hashes, and a block of each meets in one group: so a task holds a block of either and a tile of pairs, and what a query keeps
    of each block is all that is shuffled by query.
    """
    rows = read(spark, d, "embeddings").select("vec_id", "label", F.when(~F.exists("embedding", F.isnull), F.col("embedding")).alias("v")).where("vec_id is not null")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("ql"), F.col("v").alias("qv"))
    n, m = max(1, -(-asked.count() // ASKED)), max(1, -(-rows.count() // HELD))
    asked = asked if known is None else asked.join(known, "q")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = asked.select("*", F.pmod(F.xxhash64("q"), F.lit(n)).cast("int").alias("block"), each(m).alias("part"))
    held = rows.select(F.col("vec_id").alias("c"), "label", "v", F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int").alias("part"), each(n).alias("block"))

    kinds = arrow_schema(schema)
    names = kinds.names

    def run(asked, held):
        import numpy as np
        import pyarrow as pa

        as_table = lambda x: x if isinstance(x, pa.Table) else pa.table(x)
        asked, held = asked.to_pandas(), held.sort_by("c").to_pandas()
        out = []
        if len(asked) and len(held):
            (q, q_whole), (e, e_whole) = vectors(asked["qv"].tolist()), vectors(held["v"].tolist())
            e, e_whole = (e, e_whole) if q.shape[1] == e.shape[1] else (np.zeros((len(e), q.shape[1])), np.zeros(len(e), dtype=bool))
            c, step = held["c"].to_numpy(), max(1, AT_ONCE // len(held))
            for lo in range(0, len(asked), step):
                some = slice(lo, lo + step)
                score, other = similarities(q[some], e)
                lost = ~(q_whole[some][:, None] & e_whole[None, :])
                score[lost] = 0.0
                tile = asked.iloc[some].reset_index(drop=True)
                out.append(as_table(found(tile, held, score, other, tile["q"].to_numpy()[:, None] != c[None, :], lost)).select(names).cast(kinds))
        return pa.concat_tables(out) if out else kinds.empty_table()

    # with a number of tasks given, small blocks aren't put together
    deal = lambda df: df.repartition(min(2 * n * m, 4096), "block", "part").groupBy("block", "part")
    return deal(asked).cogroup(deal(held)).applyInArrow(run, schema)


PAIR = "q bigint, c bigint, relevant boolean, score double, other double"


def chosen(asked, held, mask, score, other, lost) -> dict:
    """The pairs that a mask keeps, as columns of PAIR."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    i, j = np.nonzero(mask)
    a, b = asked["ql"].to_numpy()[i], held["label"].to_numpy()[j]
    relevant = pa.array(np.asarray(a == b, dtype=bool), mask=np.asarray(pd.isna(a) | pd.isna(b), dtype=bool))
    return {"q": asked["q"].to_numpy()[i], "c": held["c"].to_numpy()[j], "relevant": relevant, "score": score[i, j], "other": pa.array(other[i, j], mask=lost[i, j])}


def semantic(spark: SparkSession, d: str, k: int | None = None) -> DataFrame:
    """(q, c, relevant, score, other): the k rows of each block with the greatest cosine for each query vector, its own left out; without k all rows."""

    def found(asked, held, score, other, may, lost):
        return chosen(asked, held, may if k is None else greatest(score, may, k), score, other, lost)

    return met(spark, d, found, PAIR)


@query(f"WITH {COS_SQL} SELECT q, c, round(score, 4) AS score, rank FROM sem WHERE rank <= 10")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return ranked(semantic(spark, d, 10), ["q"], "score", "c", 10).select("q", "c", F.round("score", 4).alias("score"), "rank")


def fuse(lists: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of rank lists (group, item, rank): ties by first rank, then by item."""
    sums = lists.groupBy(group, item).agg(F.round(F.sum(1 / (FUSION + F.col("rank"))), 9).alias("score"), F.min("rank").alias("first"))
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "first", item))
    return sums.withColumn("pos", n).where(F.col("pos") <= k)


@query(
    f"""WITH {BM25_SQL}, sh AS (SELECT item_id, doc_id, count(*) AS overlap FROM q JOIN tf USING (token) GROUP BY item_id, doc_id),
    ov AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM sh),
    u AS (SELECT item_id, doc_id, rank FROM lex WHERE rank <= 24 UNION ALL SELECT item_id, doc_id, rank FROM ov WHERE rank <= 24),
    s AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS first FROM u GROUP BY ALL)
    SELECT item_id, doc_id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first, doc_id) AS pos FROM s) WHERE pos <= 6"""
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of the lexical list with that of the most shared words; both come from the same tiles of scores."""
    found = best(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "doc_id", lexical=24, shared=24)
    value = F.when(F.col("by") == "score", F.col("score")).otherwise(F.col("overlap"))
    lists = ranked(found.select("by", "item_id", "doc_id", value.alias("value")), ["by", "item_id"], "value", "doc_id", 24)
    return fuse(lists.select("item_id", "doc_id", "rank"), "item_id", "doc_id", 6).drop("first")


def minmax(x, lo, hi):
    """Scaled to 0..1 between the query's bounds of this score; 0 where all scores are the same."""
    import numpy as np

    lo, hi = lo.to_numpy(dtype=float)[:, None], hi.to_numpy(dtype=float)[:, None]
    with np.errstate(all="ignore"):
        return np.where(hi == lo, 0.0, (x - lo) / (hi - lo))


HYBRID_SQL = f"""{COS_SQL}, hy AS (SELECT q, c, relevant, other, round((coalesce((score - min(score) OVER p) / nullif(max(score) OVER p - min(score) OVER p, 0), 0)
  + coalesce((other - min(other) OVER p) / nullif(max(other) OVER p - min(other) OVER p, 0), 0)) / 2, 6) AS score FROM sem WINDOW p AS (PARTITION BY q)),
  hr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM hy)"""


# fixed values: scores that have bounds
BOUNDS = ("score", "other")


def firsts(spark: SparkSession, d: str, single: int, hybrid: int) -> tuple[DataFrame, DataFrame]:
    """(bounds, lists). bounds: for each query the bounds of its cosines and distances, and how many rows are relevant (gold). lists: mode, q, c, relevant,
    other, score, rank; the first `single` rows of each query by cosine (semantic) and the first `hybrid` by the mean of cosine and distance, each scaled within its query.

    Bounds are an aggregate, combined in each block before its shuffle, and come back with the query. So pairs are scored twice but never brought together by query.
    """

    def bounded(asked, held, score, other, may, lost):
        import numpy as np
        import pyarrow as pa

        gold = (asked["ql"].to_numpy()[:, None] == held["label"].to_numpy()[None, :]) & may
        out = {"q": asked["q"].to_numpy(), "gold": gold.sum(axis=1)}
        for name, x, has in (("score", score, may), ("other", other, may & ~lost)):
            none = ~has.any(axis=1)
            out[f"lo_{name}"] = pa.array(np.fmin.reduce(np.where(has, x, np.inf), axis=1), mask=none)
            out[f"hi_{name}"] = pa.array(np.max(np.where(has, x, -np.inf), axis=1), mask=none)  # NaN is greatest
        return out

    ends = [f"{x}_{name} double" for name in BOUNDS for x in ("lo", "hi")]
    of_block = met(spark, d, bounded, ", ".join(["q bigint", "gold bigint", *ends]))
    sums = [F.sum("gold").alias("gold")] + [f(f"{x}_{c}").alias(f"{x}_{c}") for c in BOUNDS for x, f in (("lo", F.min), ("hi", F.max))]
    bounds = stored(of_block.groupBy("q").agg(*sums), "bounds")

    def found(asked, held, score, other, may, lost):
        import numpy as np
        import pyarrow as pa

        scaled = minmax(score, asked["lo_score"], asked["hi_score"]) + np.where(lost, 0.0, minmax(other, asked["lo_other"], asked["hi_other"]))
        both = settled((scaled / 2).ravel()).reshape(scaled.shape)
        parts = [(mode, chosen(asked, held, greatest(x, may, k), x, other, lost)) for mode, x, k in (("hybrid", both, hybrid), ("semantic", score, single)) if k]
        return pa.concat_tables([pa.table({**rows, "mode": pa.array([mode] * len(rows["q"]), pa.string())}) for mode, rows in parts])

    near = met(spark, d, found, PAIR + ", mode string", bounds.drop("gold"))
    length = F.when(F.col("mode") == "hybrid", hybrid).otherwise(single)
    n = F.row_number().over(Window.partitionBy("mode", "q").orderBy(F.desc("score"), "c"))
    return bounds, near.withColumn("rank", n).where(F.col("rank") <= length)


@query(f"WITH {HYBRID_SQL} SELECT q, c, round(score, 4) AS score, rank FROM hr WHERE rank <= 6")
def hybrid_minmax(spark: SparkSession, d: str) -> DataFrame:
    return firsts(spark, d, 0, 6)[1].select("q", "c", F.round("score", 4).alias("score"), "rank")


@query(
    f"""WITH {HYBRID_SQL}, m AS (SELECT 'semantic' AS mode, q, relevant, rank FROM sem WHERE rank <= 6
    UNION ALL SELECT 'hybrid', q, relevant, rank FROM hr WHERE rank <= 6),
    g AS (SELECT q, count(*) FILTER (WHERE relevant) AS gold FROM cs GROUP BY q),
    x AS (SELECT mode, q, count(*) FILTER (WHERE relevant) AS hits, count(*) AS n, min(rank) FILTER (WHERE relevant) AS first FROM m GROUP BY ALL)
    SELECT mode, count(*) AS queries, sum(hits)::BIGINT AS hits, round(avg(hits / n), 6) AS precision,
    round(avg(CASE WHEN gold > 0 THEN hits / gold ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr
    FROM x JOIN g USING (q) GROUP BY mode"""
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and reciprocal rank of two modes, averaged over queries."""
    bounds, lists = firsts(spark, d, 6, 6)
    gold = bounds.select("q", "gold")
    each = lists.groupBy("mode", "q").agg(
        F.count_if("relevant").alias("hits"), F.count("*").alias("n"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first")
    ).join(gold, "q")
    return each.groupBy("mode").agg(
        F.count("*").alias("queries"), F.sum("hits").alias("hits"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("precision"),
        F.round(F.avg(F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).otherwise(0.0)), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )
