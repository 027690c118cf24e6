"""Normal forms of pages with their origins as runs, and citations of normal pages with spans of the raw ones.

A run (at, raw, size) says that `size` characters of the normal form from `at` on stand in the raw page from `raw` on. A page has as many runs
as it has breaks, not as it has characters; a span goes back to the raw page by the runs that hold its first and its last character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.window import Window

from sparkquill.operators.citations import CITED, antecedents, around, excluded_pages, find
from sparkquill.operators.passages import normal_origins, running_lines
from sparkquill.sources.tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RUN = t.StructType([t.StructField(n, t.IntegerType()) for n in ("at", "raw", "size")])
NORMAL = t.StructType([t.StructField("normal", t.StringType()), t.StructField("runs", t.ArrayType(RUN))])


def runs_of(origin: list[int]) -> list[dict]:
    """Runs of an array of origins."""
    import numpy as np

    places = np.asarray(origin, dtype=np.int64)
    if not len(places):
        return []
    starts = np.flatnonzero(np.diff(places, prepend=places[0] - 2) != 1)
    sizes = np.diff(np.append(starts, len(places)))
    return [{"at": int(a), "raw": int(places[a]), "size": int(n)} for a, n in zip(starts, sizes)]


@F.pandas_udf(NORMAL)
def page_runs(raw, removed):
    import pandas as pd

    rows = [normal_origins(x or "", set() if r is None else set(r)) for x, r in zip(raw, removed)]
    return pd.DataFrame({"normal": [r[0] for r in rows], "runs": [runs_of(r[1]) for r in rows]})


def raw_place(runs: Column, at: Column) -> Column:
    """Where a character of the normal form stands in the raw page; null outside."""
    run = F.get(F.filter(runs, lambda r: (r["at"] <= at) & (at < r["at"] + r["size"])), F.lit(0))
    return run["raw"] + at - run["at"]


def raw_span(runs: Column, start: Column, end: Column) -> Column:
    """(lo, hi) in the raw page of a span of the normal form; what was left out between its characters is inside.

    An empty span is anchored where it lies, or at 0 at the end; a span that isn't within the normal form is null.
    """
    last = F.element_at(runs, -1)
    size = F.when(F.size(runs) == 0, 0).otherwise(last["at"] + last["size"])
    anchor = F.coalesce(raw_place(runs, start), F.lit(0))
    span = F.when(end > start, F.struct(raw_place(runs, start).alias("lo"), (raw_place(runs, end - 1) + 1).alias("hi"))).otherwise(F.struct(anchor.alias("lo"), anchor.alias("hi")))
    return F.when((start >= 0) & (start <= end) & (end <= size), span)


def normal_with_runs(pages: DataFrame) -> DataFrame:
    """pages (doc, page, text) with `normal` and `runs`, without running lines."""
    found = pages.join(running_lines(pages), ["doc", "page"], "left")
    found = found.withColumn("p", page_runs(F.col("text"), F.coalesce("removed", F.array().cast("array<int>"))))
    return found.select(*pages.columns, "p.*")


RAW = "raw_start int, raw_end int, raw_cited string, raw_context_start int, raw_context_end int, raw_quote_start int, raw_quote_end int, raw_quote string"


def raw_of(origin, start: int | None, end: int | None) -> tuple[int | None, int | None]:
    """As `raw_span`, from the array of origins."""
    if start is None or not 0 <= start <= end <= len(origin):
        return None, None
    first = int(origin[start]) if start < len(origin) else 0
    return (first, int(origin[end - 1]) + 1) if end > start else (first, first)


def cited_pages(pages: DataFrame) -> DataFrame:
    """Citations of pages (doc, page, text) as `extract` finds them in normal forms without running lines and tables of authorities, with their antecedents.

    raw_start, raw_end, raw_context_start and raw_context_end are characters of the raw page, raw_cited and raw_quote what stands there. Rows without a document or
    page, null texts and empty tables have no citations; each document's page is one row. A page is gone over once: its normal form, its citations and
    their raw spans are made by one task, and neither form of a page is shuffled for them.
    """
    named = pages.where(F.col("doc").isNotNull() & F.col("page").isNotNull()).select("doc", "page", "text")
    gone = excluded_pages(named, "doc").where("excluded").select("doc", "page").distinct()
    rows = named.join(gone, ["doc", "page"], "left_anti").join(running_lines(named), ["doc", "page"], "left")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("doc", "page")]
    fields, raw_fields = ([x.split()[0] for x in names.split(", ")] for names in (CITED, RAW))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for doc, page, raw, removed in pdf[["doc", "page", "text", "removed"]].itertuples(index=False):
                text, origin = normal_origins(raw or "", set() if removed is None else set(removed))
                for c in around(text, find(text)):
                    spans = [raw_of(origin, c[f"{x}start"], c[f"{x}end"]) for x in ("", "context_", "quote_")]
                    shown = [None if lo is None else raw[lo:hi] for lo, hi in spans]
                    out.append((doc, page, *(c[f] for f in fields), *spans[0], shown[0], *spans[1], *spans[2], shown[2]))
            frame = pd.DataFrame(out, columns=["doc", "page", *fields, *raw_fields])
            yield frame.astype({f: "Int32" for f in ("year", "quote_start", "quote_end", *(x for x in raw_fields if x not in ("raw_cited", "raw_quote")))})

    found = rows.mapInPandas(run, f"doc {kinds[0]}, page {kinds[1]}, {CITED}, {RAW}")
    return antecedents(found.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("page", "start"))), "doc")


#: Pages of a brief.
PAGES_EACH = 20


def brief_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of briefs: each text, then a quotation, a citation over broken lines, an id. and a short form in another spelling, then a line that all pages share."""
    k = F.col("doc_id")
    vol = (k % 7 + 1).cast("string")
    cited = F.concat(F.lit('\nStop.  It was so.\nThe rule  "holds as\nsaid," Roe  v.\nWade, '), vol, F.lit(" So. 2d  "), (k + 1).cast("string"), F.lit(" (9th  Cir. 1995)."))
    rest = F.concat(F.lit("  Id. at "), (k + 2).cast("string"), F.lit(".  Then see "), vol, F.lit(" So.2d at 9.\nThe same last line"))
    return read(spark, d, "documents").select(F.floor(k / PAGES_EACH).alias("doc"), (k % PAGES_EACH).cast("int").alias("page"), F.concat("text", cited, rest).alias("text"))


@query(
    rf"""WITH p AS (SELECT doc_id // {PAGES_EACH} AS doc, (doc_id % {PAGES_EACH})::INT AS page, length(text) AS a, (doc_id % 7 + 1)::VARCHAR AS v, (doc_id + 1)::VARCHAR AS g, (doc_id + 2)::VARCHAR AS i
      FROM documents WHERE text IS NOT NULL),
    q AS (SELECT *, E'\nStop.' AS s0, E'  It was so.' AS s1, E'\nThe rule  "holds as\nsaid," ' AS s2, E'Roe  v.\nWade, ' || v || ' So. 2d  ' || g || ' (9th  Cir. 1995)' AS c1, 'Id. at ' || i AS c2, v || ' So.2d at 9' AS c3 FROM p),
    r AS (SELECT doc, page, 1 AS k, 'full' AS kind, a + length(s0 || s1 || s2) AS raw_start, c1 AS raw_cited, a + length(s0) AS raw_context_start, a + length(s0 || s1 || s2 || c1) + 1 AS raw_context_end,
        'holds as' || chr(10) || 'said,' AS quoted, v FROM q
      UNION ALL SELECT doc, page, 2, 'id', a + length(s0 || s1 || s2 || c1) + 3, c2, a + length(s0 || s1), a + length(s0 || s1 || s2 || c1) + 3 + length(c2) + 1, 'holds as' || chr(10) || 'said,', v FROM q
      UNION ALL SELECT doc, page, 3, 'short', a + length(s0 || s1 || s2 || c1) + 3 + length(c2) + length('.  Then see '), c3, a + length(s0 || s1 || s2 || c1) + 1,
        a + length(s0 || s1 || s2 || c1) + 3 + length(c2) + length('.  Then see ') + length(c3) + 1, NULL, v FROM q),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, k) AS n FROM r),
    f AS (SELECT a.doc, a.n, count(b.n) AS same, max(b.n) AS root FROM n a JOIN n b ON b.doc = a.doc AND b.kind = 'full' AND b.v = a.v AND b.n < a.n WHERE a.kind = 'short' GROUP BY ALL)
    SELECT doc, page, kind, raw_start, raw_cited, raw_context_start, raw_context_end, quoted, n::INT AS n,
      CASE kind WHEN 'id' THEN n - 1 WHEN 'short' THEN CASE WHEN same = 1 THEN root END END::INT AS root FROM n LEFT JOIN f USING (doc, n)"""
)
def citation_raw_spans(spark: SparkSession, d: str) -> DataFrame:
    """Citations of all pages, with the raw spans of citations, contexts and quotations, and the citation that each refers to."""
    found = cited_pages(brief_pages(spark, d))
    return found.select("doc", "page", "kind", "raw_start", "raw_cited", "raw_context_start", "raw_context_end", F.col("raw_quote").alias("quoted"), "n", "root")
