"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Each text version is a blob named by its SHA-256. The ledger holds one row per (blob, rule version) that was
scanned, with the spans found. A scan reads only texts of pairs that the ledger lacks, once per blob however
many paths share it; findings are joined back to all paths.
"""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.llm.common import packed, stored, table, unpacked

#: (kind, Java pattern, group whose length is tested, least length), in the order that breaks ties.
#: Runs of AKIA or hex characters that are too short can't hold a longer match, so their least length is in
#: the pattern; a short password value is matched, and skipped past, before it is dropped.
RULES = (
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Follows from the rules themselves, so findings of other rules are never taken for these.
RULE_VERSION = zlib.crc32(repr(RULES).encode()) >> 1
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
LEDGER = f"blob binary, rule_version int, found {SPAN}"
#: A blob with a HOT-th of all paths is met in several parts.
HOT = 500
#: Characters that a text is cut into for its redaction, so that a place in it is found without reading it from its start.
CHUNK = 4096


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def hits(text: Column, pattern: str, group: int) -> Column:
    """For each match of a pattern: characters between it and the match before, its own, and those of the tested group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    size = lambda parts: F.transform(parts, lambda x: F.length(x))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    found = F.arrays_zip(size(gaps).alias("gap"), size(whole).alias("hit"), size(tested).alias("value"))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<gap:int,hit:int,value:int>>"))


def spans_of(texts: DataFrame) -> DataFrame:
    """(blob, found) of each distinct blob of texts (blob, text): all spans of all rules, by start and then by the rules' order.

    Matches are rows, and their places are running sums over one blob's rows, so the cost is in proportion to their number.
    """
    every = texts.select("blob", F.array(*[F.struct(F.lit(n).alias("rank"), hits(F.col("text"), p, g).alias("parts")) for n, (_, p, g, _) in enumerate(RULES)]).alias("rules"))
    every = stored(every, "secret-hits")  # numbers only; blobs without a match are rows too
    rows = every.select("blob", F.explode("rules").alias("r")).select("blob", "r.rank", F.posexplode("r.parts").alias("pos", "part"))
    # rows that repeat a blob (an id with its very text twice) give the same matches
    rows = rows.groupBy("blob", "rank", "pos").agg(F.first("part").alias("part"))
    end = F.sum(F.col("part.gap") + F.col("part.hit")).over(Window.partitionBy("blob", "rank").orderBy("pos"))
    kinds, least = (F.array(*[F.lit(r[i]) for r in RULES]) for i in (0, 3))
    nth = F.col("rank") + 1
    placed = rows.withColumn("end", end).where(F.col("part.value") >= F.element_at(least, nth))
    one = F.struct((F.col("end") - F.col("part.hit")).alias("start"), "rank", "end", F.element_at(kinds, nth).alias("kind")).alias("span")
    marks = every.select("blob", F.lit(None).cast(SPAN[6:-1]).alias("span")).unionByName(placed.select("blob", one))
    return marks.groupBy("blob").agg(F.array_sort(F.collect_list("span")).alias("found"))


def open_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """(blob, rule_version, found) so far, each pair once, though two runs at the same time may both have scanned it; empty where nothing is yet."""
    if path is not None:
        try:
            rows = spark.read.schema(LEDGER).parquet(path)
            return rows.groupBy("blob", "rule_version").agg(F.first("found").alias("found"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], LEDGER)


def scan_unseen(docs: DataFrame, paths: DataFrame, ledger: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """New ledger rows: texts of blobs without a row of this rule version, each scanned once."""
    unseen = (
        paths.groupBy("__blob")
        .agg(F.min("__id").alias("__id"))
        .join(
            ledger.where(F.col("rule_version") == RULE_VERSION).select(F.col("blob").alias("__blob")),
            "__blob",
            "left_anti",
        )
    )
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(text, F.lit("")).alias("text"), blob_of(text).alias("blob")).alias("t")
    only = unseen.hint("shuffle_hash").alias("u")
    same = F.col("t.__id").eqNullSafe(F.col("u.__id")) & (F.col("t.blob") == F.col("u.__blob"))
    found = spans_of(texts.join(only, same, "left_semi").select("blob", "text"))
    return found.select("blob", F.lit(RULE_VERSION).alias("rule_version"), "found")


def located(docs: DataFrame, id_col: str, text_col: str, ledger_path: str | None) -> DataFrame:
    """(__id, __blob, found) for each input row; found is null where nothing was found."""
    spark = docs.sparkSession
    paths = stored(docs.select(F.col(f"`{id_col}`").alias("__id"), blob_of(F.col(f"`{text_col}`")).alias("__blob")), "secret-paths")
    known = open_ledger(spark, ledger_path)
    new = stored(scan_unseen(docs, paths, known, id_col, text_col), "secret-ledger")
    found = known.where(F.col("rule_version") == RULE_VERSION).unionByName(new).where(F.size("found") > 0).select(F.col("blob").alias("__blob"), "found")
    # blobs with a HOT-th of all paths (HOT at most) are dealt to as many parts as the cluster has cores
    sizes = paths.groupBy("__blob").agg(F.count("*").alias("n"))
    hot = F.broadcast(stored(sizes.where(F.col("n") * HOT >= F.lit(paths.count())).select("__blob", F.lit(True).alias("__hot")), "secret-hot"))
    parts = max(2, spark.sparkContext.defaultParallelism)
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")
    split = paths.join(hot, "__blob", "left").withColumn("__salt", F.when(F.col("__hot"), dealt).otherwise(0))
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    copied = found.join(hot, "__blob", "left").select("__blob", "found", F.explode(copies).alias("__salt"))
    result = split.join(copied, ["__blob", "__salt"], "left").select("__id", "__blob", "found")
    if ledger_path is not None:
        result = stored(result, "secret-findings")
        new.write.mode("append").parquet(ledger_path)
    return result


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None
) -> DataFrame:
    """One row per input row: id, found (array of start, rank, end, kind in code points, end exclusive).

    Null text counts as empty and has no findings; null ids and repeated rows keep their rows; an empty table
    gives no rows; other columns aren't read. With ledger_path new rows are appended there (the first run makes the folder) and
    known pairs are not scanned again; without it the ledger is a fresh table in the shared folder.
    """
    return located(docs, id_col, text_col, ledger_path).select(
        F.col("__id").alias(id_col), F.coalesce("found", F.array().cast(SPAN)).alias("found")
    )


def as_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    spans = as_text(F.col("found"))
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans")
    )


def cut(text: Column, spans: Column, size: Column) -> Column:
    """text with each of spans (start, before, end, kind; none overlap) replaced by its mark; `size` is where the last one ends."""

    def of(chunks: Column) -> Column:
        def part(lo: Column, hi: Column | None = None) -> Column:
            at = F.floor(lo / CHUNK).cast("int")
            n = (F.floor(hi / CHUNK).cast("int") - at + 1) if hi is not None else F.size(chunks)
            near = F.array_join(F.slice(chunks, at + 1, n), "")
            return F.substring(near, (lo % CHUNK).cast("int") + 1, (hi - lo).cast("int") if hi is not None else F.length(near))

        marked = F.transform(spans, lambda s: F.concat(part(s["before"], s["start"]), F.lit("[REDACTED:"), s["kind"], F.lit("]")))
        return F.concat(F.array_join(marked, ""), part(size))

    # the chunks are bound once, as the only item of an array, and not cut anew for each span
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.transform(F.array(chunks), of)[0]


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by [REDACTED:kind]; spans that overlap become one. n_chars, if there, follows.

    Rows without findings are passed on as they are, so a clean text is never changed and a null one stays null. Null ids, repeated rows
    and other columns, whatever their names, are passed on; an empty table gives none.
    """
    found = located(docs, id_col, text_col, None).where(F.col("found").isNotNull()).select("__id", "__blob", "found")
    blobs = found.groupBy("__blob").agg(F.first("found").alias("found")).select("__blob", F.explode("found").alias("s")).select("__blob", "s.*")
    # a span begins a mark where none before it has reached; `before` is where what precedes the mark begins
    earlier = Window.partitionBy("__blob").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    blobs = blobs.withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    fresh = F.when(F.col("start") >= F.col("before"), F.struct("start", "before", "end", "kind"))
    marks = blobs.groupBy("__blob").agg(F.array_sort(F.collect_list(fresh)).alias("__spans"), F.max("end").alias("__last"))
    marks = found.select("__id", "__blob").distinct().join(marks, "__blob")
    text = F.col(f"`{text_col}`")
    rows = packed(docs, __i=F.col(f"`{id_col}`"), __b=blob_of(text), __text=text)
    joined = rows.join(marks, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__b") == F.col("__blob")), "left")
    dirty = F.col("__spans").isNotNull()
    clean = F.when(dirty, cut(F.col("__text"), F.col("__spans"), F.col("__last"))).otherwise(F.col("__text"))
    joined = joined.select("__doc", dirty.alias("__dirty"), clean.alias("__clean"))
    doc = F.col("__doc").withField(f"`{text_col}`", F.col("__clean"))
    if "n_chars" in docs.columns:
        size = F.length("__clean").cast(docs.schema["n_chars"].dataType)
        doc = doc.withField("n_chars", F.when(F.col("__dirty"), size).otherwise(F.col("__doc.n_chars")))
    return unpacked(joined.select(doc.alias("__doc")))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text FROM documents),
r(k, kind, pattern, g, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  (1, 'access', 'AKIA[A-Z0-9]{12,}', 0, 16),
  (2, 'hex', '[0-9a-f]{32,}', 0, 32)),
m AS (
  SELECT n, k, kind, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, vals
  FROM (
    SELECT n, 0 AS k, 'assign' AS kind, 8 AS least, regexp_extract_all(text, p, 0) AS hits,
           regexp_extract_all(text, p, 2) AS vals, regexp_split_to_array(text, p) AS gaps
    FROM t, (SELECT pattern AS p FROM r WHERE k = 0)
    UNION ALL
    SELECT n, r.k, r.kind, r.least, regexp_extract_all(text, r.pattern), regexp_extract_all(text, r.pattern),
           regexp_split_to_array(text, r.pattern)
    FROM t JOIN r ON r.k > 0)
  WHERE len(hits) > 0),
s AS (
  SELECT n, k, kind, least, length(vals[i]) AS size,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) +
         coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start, length(hits[i]) AS len
  FROM m),
f AS (
  SELECT n, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
         string_agg(kind || ':' || start::BIGINT || ':' || (start + len)::BIGINT, ',' ORDER BY start, k) AS spans
  FROM s WHERE size >= least GROUP BY n)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN f USING (n)
"""
