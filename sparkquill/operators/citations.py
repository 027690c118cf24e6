"""Citations in pages: extraction by a grammar of reporters, antecedents, quotes."""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.sources.tables import dealt, dealt_sql, read, stored

QUERIES, SQL = {}, {}

# fixed values: reporters that are told apart
REPORTERS = (
    r"U\.S\.", r"S\. ?Ct\.", r"L\. ?Ed\. ?2d", r"F\.2d", r"F\.3d", r"F\.4th", r"F\. ?Supp\. ?2d", r"F\. ?Supp\. ?3d", r"F\. ?Supp\.", r"F\.R\.D\.", r"B\.R\.",
    r"N\.E\.2d", r"N\.E\.3d", r"N\.W\.2d", r"P\.2d", r"P\.3d", r"A\.2d", r"A\.3d", r"S\.E\.2d", r"S\.W\.2d", r"S\.W\.3d", r"So\. ?2d", r"So\. ?3d",
    r"Cal\. ?[2345]th", r"Cal\. ?App\. ?[2345]th", r"N\.Y\.2d", r"N\.Y\.3d", r"A\.D\.[23]d", r"NY Slip Op", r"WL",
)
_REP = "(?P<rep>" + "|".join(REPORTERS) + ")"
# fixed values: a pinpoint is a page, a span of pages, or several of them
_PIN = r"(?P<pin>\d+(?:[-–]\d+)?(?:, ?\d+(?:[-–]\d+)?)*)"
#: Words of a party's name: capitals, and small words that stand between them.
_WORD, _SMALL = r"[A-Z][\w.'&]*", r"(?:of|the|and|for|in|on|to|de|la|ex|rel\.|re|&|d/b/a)"
_NAME = rf"(?P<name>(?:In re|Ex parte) {_WORD}(?: {_WORD})*|(?!(?:In|See|But|Cf\.|And|Under|Compare) ){_WORD}(?: (?:{_WORD}|{_SMALL}))*? v\. {_WORD}(?: (?:[A-Z&][\w.'&]*|of|the))*)"
FULL = re.compile(rf"(?:{_NAME}, )?(?P<vol>\d+) {_REP} (?P<page>\d+)(?!\w)(?:, {_PIN}(?= \())?(?: \((?P<court>[^()]*?)(?P<year>\d{{4}})\))?")
SHORT = re.compile(rf"(?:(?P<name>[A-Z][\w.'&]*(?: [A-Z][\w.'&]*)*), )?(?P<vol>\d+) {_REP},? at {_PIN}")
ID = re.compile(rf"\b[Ii]d\.(?:,? at {_PIN})?")
SUPRA = re.compile(rf"(?P<name>[A-Z][\w.'&]*(?: [A-Z][\w.'&]*)*), supra(?:,? at {_PIN})?")
# fixed values: where a sentence ends, a quotation in a line, and the first section after a table of authorities
SENTENCE_END = re.compile(r"[.!?][\"')\]]*(?=\s+[A-Z\"'])")
QUOTED = re.compile(r'(?P<open>["“])(?P<text>.*?)(?P<close>["”])', re.S)
SECTION_START = r"(?m)^\s*\d+\s*$\n\s*[A-Z][A-Z0-9\s]{5,}$"


def find(text: str) -> list[dict]:
    """Citations of one page in order; where grammars overlap, the earlier and then the longer match stays."""
    found = [(m.start(), -m.end(), kind, m) for kind, p in (("full", FULL), ("short", SHORT), ("id", ID), ("supra", SUPRA)) for m in p.finditer(text)]
    out, at = [], 0
    for start, end, kind, m in sorted(found, key=lambda x: x[:2]):
        if start >= at:
            at, g = -end, m.groupdict()
            year, court = g.get("year"), (g.get("court") or "").strip(" ,")
            out.append({
                "kind": kind, "start": start, "end": -end, "raw_text": m.group(), "name": g.get("name"), "volume": g.get("vol"), "reporter": g.get("rep"),
                "pin": g.get("pin"), "year": int(year) if year else None, "court": court or None,
            })
    return out


def sentence_starts(text: str) -> list[int]:
    """Places where sentences begin; 'v.' ends none."""
    ends = (m for m in SENTENCE_END.finditer(text) if not re.search(r"\b[vV]\.$", text[max(0, m.start() - 2) : m.start() + 1]))
    return [0, *(m.end() for m in ends)]


def window(text: str, starts: list[int], at: int) -> tuple[int, int, int]:
    """(start of the sentence before, start of the sentence around a place, its end)."""
    n = bisect.bisect_right(starts, at) - 1
    return starts[max(0, n - 1)], starts[n], starts[n + 1] if n + 1 < len(starts) else len(text)


def last_quote(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The last quotation in a stretch; straight marks pair with straight ones, curly with curly."""
    pairs = {'"': '"', "“": "”"}
    found = [m.span("text") for m in QUOTED.finditer(text, lo, hi) if m["close"] == pairs[m["open"]] and m["text"].strip()]
    return found[-1] if found else None


def block_quote(text: str, at: int) -> tuple[int, int] | None:
    """Two or more indented lines right before a place, the first opened and the last closed by a quotation mark: what is between the marks."""
    block = re.search(r"(?:^[ \t]+\S[^\n]*\n){2,}\s*\Z", text[:at], re.M)
    if block is None:
        return None
    inner = block.group().strip()
    lo = block.start() + block.group().index(inner)
    return (lo + 1, lo + len(inner) - 1) if inner[0] in "\"“" and inner[-1] in "\"”" and len(inner) > 2 else None


def around(text: str, cites: list[dict]) -> list[dict]:
    """cites with context (the sentence around each and the one before) and quote (its block, or the last in these sentences), as spans and texts."""
    starts = sentence_starts(text)
    for c in cites:
        before, here, end = window(text, starts, c["start"])
        quote = block_quote(text, c["start"])
        c["is_block"] = quote is not None
        quote = quote or last_quote(text, here, end) or last_quote(text, before, here)
        context = text[before:end]
        c["context_start"], c["context_end"], c["context"] = before, end, context.strip()
        c["quote_start"], c["quote_end"] = quote or (None, None)
        c["quote"] = text[slice(*quote)] if quote else None
    return cites


def excluded_pages(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """(id, page, excluded): pages of a table of authorities, from its heading up to the first numbered page that begins a section.

    Null texts change nothing. A document's pages are one window, of which only two flags are sorted.
    """
    flag = F.when(F.upper(text_col).contains("TABLE OF AUTHORITIES"), True).when(F.col(text_col).rlike(SECTION_START), False)
    w = Window.partitionBy(id_col).orderBy(page_col)
    return pages.select(id_col, page_col, flag.alias("f")).select(id_col, page_col, F.coalesce(F.last("f", ignorenulls=True).over(w), F.lit(False)).alias("excluded"))


CITED = (
    "kind string, start int, end int, raw_text string, name string, volume string, reporter string, pin string, year int, court string, is_block boolean, "
    "context_start int, context_end int, context string, quote_start int, quote_end int, quote string"
)


def extract(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page", text_col: str = "text", skip_tables: bool = True) -> DataFrame:
    """(id, page, n and the columns CITED), n in document order; null text has none, nor has a table of authorities if `skip_tables`.

    Where a page repeats, its citations are there for each.
    """
    rows = pages.select(id_col, page_col, text_col)
    if skip_tables:
        gone = excluded_pages(rows, id_col, page_col, text_col).where("excluded").select(id_col, page_col).distinct()
        rows = rows.join(gone, [id_col, page_col], "left_anti").select(id_col, page_col, text_col)
    kinds = [rows.schema[c].dataType.simpleString() for c in (id_col, page_col)]
    fields = [x.split()[0] for x in CITED.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(a, b, *(c[f] for f in fields)) for a, b, t in pdf.itertuples(index=False) for c in around(t or "", find(t or ""))]
            frame = pd.DataFrame(out, columns=[id_col, page_col, *fields])
            yield frame.astype({f: "Int32" for f in ("year", "quote_start", "quote_end")})

    found = rows.mapInPandas(run, f"{id_col} {kinds[0]}, {page_col} {kinds[1]}, {CITED}")
    return found.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy(page_col, "start")))


#: Beginnings of guesses up to which a text is searched for each; for more, all its runs are made.
FEW = 64


def antecedents(cites: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds root (n of the full citation meant; null if unresolved or full).

    Short and supra forms go to the newest full citation before them whose name or text holds their name, else to the only
    one with their volume and reporter. An id. goes to the last resolved citation before it.

    Citations are written once, as several joins read them: pages are gone over a single time. Their file is far smaller than their rows, since
    texts repeat in it; Spark would broadcast them by its size, so the joins are told to sort and merge.
    """
    cites = stored(cites, "cites")
    full = cites.where("kind = 'full'").select(
        F.col(id_col).alias("d"), F.col("n").alias("m"), F.col("name").alias("f_name"), F.col("raw_text").alias("f_raw"), F.col("volume").alias("f_vol"), F.col("reporter").alias("f_rep")
    )
    back = cites.where("kind in ('short', 'supra')").select(F.col(id_col).alias("b_d"), F.col("n").alias("b_n"), F.lower("name").alias("guess"), "volume", "reporter")
    # a name's first letters are a run of the text that holds it: the key of an equi-join
    guesses = back.where(F.coalesce("guess", F.lit("")) != "").withColumn("run", F.substring("guess", 1, 3))
    held = F.concat(F.lower(F.coalesce("f_name", F.lit(""))), F.lit("\n"), F.lower("f_raw"))
    # only the runs that a document's guesses begin with are taken from its texts
    begun = guesses.groupBy(F.col("b_d").alias("d")).agg(F.collect_set("run").alias("begun"))
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("held")), lambda i: F.array(*[F.substring(F.col("held"), i, F.lit(k)) for k in (1, 2, 3)]))))
    met = F.when(F.size("begun") <= FEW, F.filter("begun", lambda r: F.contains(F.col("held"), r))).otherwise(F.array_intersect(runs, "begun"))
    named = full.withColumn("held", held).join(begun.hint("merge"), "d").select("d", "m", "f_name", "f_raw", F.explode(met).alias("run"))
    holds = F.contains(F.lower(F.coalesce("f_name", F.lit(""))), F.col("guess")) | F.contains(F.lower("f_raw"), F.col("guess"))
    on = (F.col("b_d") == F.col("d")) & (F.col("m") < F.col("b_n"))
    by_name = guesses.join(named.withColumnRenamed("run", "f_run").hint("merge"), on & (F.col("run") == F.col("f_run"))).where(holds).groupBy("b_d", "b_n").agg(F.max("m").alias("by_name"))
    # a reporter's identity doesn't hang on its spaces: S. Ct. and S.Ct. are one
    spelled = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    same = on & (F.col("volume") == F.col("f_vol")) & (spelled("reporter") == spelled("f_rep"))
    by_key = back.join(full.hint("merge"), same).groupBy("b_d", "b_n").agg(F.count("*").alias("same"), F.max("m").alias("by_key"))
    met = back.select("b_d", "b_n").join(by_name.hint("merge"), ["b_d", "b_n"], "left").join(by_key.hint("merge"), ["b_d", "b_n"], "left").withColumnsRenamed({"b_d": id_col, "b_n": "n"})
    root = F.coalesce("by_name", F.when(F.col("same") == 1, F.col("by_key")))
    known = cites.join(met.select(id_col, "n", root.alias("own")).hint("merge"), [id_col, "n"], "left")
    points = F.when(F.col("kind") == "full", F.col("n")).otherwise(F.col("own"))
    before = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(points, ignorenulls=True).over(before)
    return known.withColumn("root", F.when(F.col("kind") == "id", last).otherwise(F.col("own"))).drop("own")


# fixed values: pages and the citations in them
PAGES = (
    ("a", 1, "Roe v. Wade, 410 U.S. 113, 155 (1973). Roe, 410 U.S. at 120. Id. at 121. Roe, supra, at 122."),
    ("b", 1, "Id. at 12. Smith, supra, at 4."),
    ("c", 1, "Coal. v. Aracoma Coal Co., 556 F.3d 177, 201 (4th Cir. 2009). Ohio Valley, 556 F.3d at 201. 401 U.S. 402. Overton Park, 401 U.S. at 415."),
    ("d", 1, "Alpha v. One, 401 U.S. 402 (1971). Beta v. Two, 401 U.S. 403 (1971)."),
    ("d", 2, "Overton Park, 401 U.S. at 415."),
)
EXPECTED = (
    ("a", 1, "full", "155", 1973, None), ("a", 2, "short", "120", None, 1), ("a", 3, "id", "121", None, 1), ("a", 4, "supra", "122", None, 1),
    ("b", 1, "id", "12", None, None), ("b", 2, "supra", "4", None, None),
    ("c", 1, "full", "201", 2009, None), ("c", 2, "short", "201", None, 1), ("c", 3, "full", None, None, None), ("c", 4, "short", "415", None, 3),
    ("d", 1, "full", None, 1971, None), ("d", 2, "full", None, 1971, None), ("d", 3, "short", "415", None, None),
)
SQL["citation_antecedents"] = dealt_sql("customer", "c_custkey", [(e[0] + "{k}", *e[1:]) for e in EXPECTED], "doc_id, n, kind, pin, year, root", every=True)


def citation_antecedents(spark: SparkSession, d: str) -> DataFrame:
    """Citations of four briefs for each row, with the citation that each refers to."""
    pages = dealt(spark, d, "customer", "c_custkey", [(p[0] + "{k}", *p[1:]) for p in PAGES], "doc_id string, page int, text string", every=True)
    found = antecedents(extract(pages)).select("doc_id", "n", "kind", "pin", "year", "root")
    return found.withColumn("k", F.substring("doc_id", 2, 20).cast("bigint"))


QUERIES["citation_antecedents"] = citation_antecedents

QUOTES = (
    ("before", '"The Court held this {k}." Roe v. Wade, 410 U.S. 113 (1973).', "The Court held this {k}."),
    ("within", 'Roe v. Wade, 500 N.E.2d 1{k} (1973), held that "the rule {k} applies."', "the rule {k} applies."),
    ("curly", "“The Court held this {k}.” In re Poe, 10 F.3d 20 (9th Cir. 1995).", "The Court held this {k}."),
    ("far", '"The Court held this." Another sentence stands here. Roe v. Wade, 410 U.S. 113 (1973).', None),
    ("block", 'It said:\n    "The first line stands {k}\n    and the second one ends."\nRoe v. Wade, 12 Cal. 4th 345 (1995).', "The first line stands {k}\n    and the second one ends."),
    ("none", "Roe v. Wade, 2019 WL 12345 (1973).", None),
)
SQL["quote_attach"] = dealt_sql("customer", "c_custkey", [(q[0], q[2]) for q in QUOTES], '"case", quote')


def quote_attach(spark: SparkSession, d: str) -> DataFrame:
    """The quotation that belongs to a citation: a block before it, the last one of its sentence, else of the sentence before."""
    rows = dealt(spark, d, "customer", "c_custkey", [(q[0], 1, q[1]) for q in QUOTES], "case string, page int, text string")
    return rows.select("k", "case").join(extract(rows, "k").select("k", "quote"), "k")


QUERIES["quote_attach"] = quote_attach


def cited_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of one citation each, made from their first words, so that offsets, courts and contexts are known on a whole table."""
    return read(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 20).alias("brief"), (F.col("doc_id") % 20).cast("int").alias("page"),
        F.concat(F.lit("It was so. The rule holds, Roe v. Wade, "), F.col("doc_id") + 1, F.lit(" F.3d "), F.length("text") + 1, F.lit(" (9th Cir. 1995). Id. at "), F.col("doc_id"), F.lit(". And then.")).alias("text"),
    )


SQL["citation_table"] = """WITH p AS (SELECT doc_id // 20 AS brief, (doc_id % 20)::INT AS page, (doc_id + 1)::VARCHAR AS v, (length(text) + 1)::VARCHAR AS g, doc_id::VARCHAR AS i FROM documents WHERE text IS NOT NULL),
    c AS (SELECT brief, page, 1 AS k, 'full' AS kind, 27 AS start, 'Roe v. Wade, ' || v || ' F.3d ' || g || ' (9th Cir. 1995)' AS raw_text, '9th Cir.' AS court, NULL AS pin,
      'It was so. The rule holds, Roe v. Wade, ' || v || ' F.3d ' || g || ' (9th Cir. 1995).' AS context FROM p
      UNION ALL SELECT brief, page, 2, 'id', (27 + length('Roe v. Wade, ' || v || ' F.3d ' || g || ' (9th Cir. 1995). '))::INT, 'Id. at ' || i, NULL, i,
      'The rule holds, Roe v. Wade, ' || v || ' F.3d ' || g || ' (9th Cir. 1995). Id. at ' || i || '.' FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY brief ORDER BY page, k) AS n FROM c)
    SELECT brief, page, kind, start, raw_text, court, pin, context, n::INT AS n, CASE WHEN kind = 'id' THEN (n - 1)::INT END AS root FROM n"""


def citation_table(spark: SparkSession, d: str) -> DataFrame:
    """Citations of all pages with their courts, contexts and antecedents."""
    return antecedents(extract(cited_documents(spark, d), "brief"), "brief").select("brief", "page", "kind", "start", "raw_text", "court", "pin", "context", "n", "root")


QUERIES["citation_table"] = citation_table
