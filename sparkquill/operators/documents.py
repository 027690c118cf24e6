"""Documents and pages: paragraphs, running lines, normal forms, redaction, provenance, URL policy, islands."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.functions import text as T
from sparkquill.operators.citations import excluded_pages
from sparkquill.sources.tables import dealt, dealt_sql, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def paragraphs(docs: DataFrame, separator: str = r"\n\s*\n+", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, para_no, text): trimmed, non-empty paragraphs, numbered from 1."""
    parts = F.filter(F.transform(F.split(text_col, separator), T.strip), lambda x: x != "")
    return docs.select(id_col, F.posexplode(parts).alias("para_no", "text")).withColumn("para_no", F.col("para_no") + 1)


def _paragraphs_sql(text: str, separator: str) -> str:
    return (
        r"""SELECT doc_id, i::INT AS para_no, sha256(p[i]) AS sha256 FROM (SELECT doc_id,
    list_filter(list_transform(string_split_regex(""" + text + ", '" + separator + r"""'), lambda x: regexp_replace(x, '^"""
        + T.SPACE_SQL + "+|" + T.SPACE_SQL + """+$', '', 'g')), lambda x: x <> '') AS p FROM documents), unnest(range(1, len(p) + 1)) AS r(i)"""
    )


@query(_paragraphs_sql("text", r"\n"))
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents, whose texts part them by line breaks."""
    return paragraphs(read(spark, d, "documents"), "\n").select("doc_id", "para_no", F.sha2("text", 256).alias("sha256"))


@query(_paragraphs_sql(r"regexp_replace(text, '\.\n', E'.\n \n\n', 'g')", r"\n\s*\n+"))
def paragraph_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs parted by blank lines, the default: of documents with a blank line after each line that ends a sentence."""
    docs = read(spark, d, "documents").withColumn("text", F.regexp_replace("text", r"\.\n", ".\n \n\n"))
    return paragraphs(docs).select("doc_id", "para_no", F.sha2("text", 256).alias("sha256"))


@query(
    """WITH l AS (SELECT source AS doc, doc_id AS page, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^"""
    + T.SPACE_SQL + "+|" + T.SPACE_SQL + """+$', '', 'g')), lambda x: x <> '') AS p FROM documents), e AS (SELECT doc, page, lower(unnest([p[1], p[-1]])) AS line FROM l)
    SELECT doc, line, count(DISTINCT page) AS pages FROM e WHERE length(line) >= 4 AND NOT regexp_full_match(line, '\\d{1,3}')
    GROUP BY ALL HAVING count(DISTINCT page) >= 2"""
)
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """First or last lines that two or more pages of a document share."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    edges = read(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), lines.alias("p")).where(F.size("p") > 0)
    edges = edges.select("doc", "page", F.explode(F.array(F.element_at("p", 1), F.element_at("p", -1))).alias("line"))
    edges = edges.withColumn("line", F.lower("line")).where((F.length("line") >= 4) & ~F.col("line").rlike(r"^\d{1,3}$"))
    return edges.groupBy("doc", "line").agg(F.countDistinct("page").alias("pages")).where("pages >= 2")


@query(
    rf"""SELECT doc_id, sha256(trim(translate(regexp_replace(regexp_replace(text, '[-‐‑][\r\n](\p{{L}})', '\1', 'g'), '{T.SPACE_SQL}+', ' ', 'g'),
    '{T.PAGE_FROM}', '{T.PAGE_TO.replace("'", "''")}'))) AS normal,
    sha256(lower(regexp_replace(text, '{T.SPACE_SQL}+', '', 'g'))) AS key,
    length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS docket_chars,
    sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS discovery FROM documents"""
)
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select(
        "doc_id", F.sha2(T.page_form(t), 256).alias("normal"), F.sha2(T.match_key(t), 256).alias("key"),
        F.length(T.docket_key(t)).cast("bigint").alias("docket_chars"), F.sha2(T.discovery_form(t), 256).alias("discovery"),
    )


@query(
    r"""SELECT doc_id, text LIKE '%@%' AS has_at, sha256(replace(trim(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b',
    '[redacted email]', 'g'), '[ \t\n\f\r\v]+', ' ', 'g')), '|', '\|')) AS redacted FROM documents"""
)
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", t.contains("@").alias("has_at"), F.sha2(T.cell(t), 256).alias("redacted"))


@query(
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)\b(?:fabricat\w*|fake|lied|lying|liar|AI[ -]?generated|cheated|cheating|cheater)\b'))), ',')
    AS words FROM documents"""
)
def language_lint(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(T.denied_words(F.col("text")), ",").alias("words"))


@query("SELECT source, count(*) AS n, min(sha256(text)) AS first_sha256, max(sha256(text)) AS last_sha256 FROM documents GROUP BY source")
def sha256_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("source", F.sha2("text", 256).alias("h"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.min("h").alias("first_sha256"), F.max("h").alias("last_sha256"))


HOST_SQL = r"nullif(regexp_replace(regexp_extract(lower(url), '^https?://([^/?#@\s:]+)(?::\d+)?(?:[/?#].*)?$', 1), '\.$', ''), '')"


@query(f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host"))


def glob(pattern: str) -> str:
    """The regular expression of a glob: any characters, one, one of a set or, after an exclamation mark, one outside of it; an open bracket stands for itself."""
    out = []
    for part in re.split(r"(\[!?\]?[^\]]*\]|.)", pattern):
        if len(part) > 1:
            out.append("[^" * (part[1] == "!") + "[" * (part[1] != "!") + re.sub(r"([\\\[\]&^])", r"\\\1", part[1 + (part[1] == "!") : -1]) + "]")
        elif part:
            out.append({"*": ".*", "?": "."}.get(part, re.escape(part)))
    return "".join(out)


def matches(host: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a host is of any pattern: a glob, or a domain with those under it. Patterns are configuration, not data."""
    hit = F.lit(False)
    for p in patterns:
        if any(c in p for c in "*?["):
            hit = hit | host.rlike(f"^(?:{glob(p)})$")
        elif p:
            hit = hit | (host == p) | host.endswith("." + p)
    return F.coalesce(hit, F.lit(False))


@query(
    f"""SELECT page_id, coalesce(NOT (regexp_full_match(h, 'm\\..*') OR h = 'thth.example.org') AND
    (regexp_full_match(h, '.*\\.example\\.com') OR h = 'example.org' OR suffix(h, '.example.org')), false) AS may_fetch FROM (SELECT page_id, {HOST_SQL} AS h FROM pages)"""
)
def url_policy(spark: SparkSession, d: str) -> DataFrame:
    """A host may be fetched if it is allowed and not denied; without a host it may not."""
    h = T.host(F.col("url"))
    may = matches(h, ("*.example.com", "example.org")) & ~matches(h, ("m.*", "thth.example.org"))
    return read(spark, d, "pages").select("page_id", may.alias("may_fetch"))


# fixed values: points of a candidate for the case's name, a party, its year, its official host and a direct link
POINTS = {"name": 100, "party": 200, "year": 20, "host": 50, "direct": 1000}


def priority(title: Column, url: Column, name: Column, parties: Column, year: Column, domain: Column, direct: Column) -> Column:
    """Points of a search result for a citation; `parties` and `direct` (addresses) are arrays. Nulls give none."""
    hay = T.discovery_form(F.concat_ws(" ", title, url))
    has = lambda c: F.coalesce((T.discovery_form(c) != "") & hay.contains(T.discovery_form(c)), F.lit(False))
    facts = {
        "name": has(name), "party": F.coalesce(F.exists(parties, has), F.lit(False)), "year": F.coalesce(hay.contains(year.cast("string")), F.lit(False)),
        "host": F.coalesce(T.host(url) == F.lower(domain), F.lit(False)), "direct": F.coalesce(F.array_contains(direct, url), F.lit(False)),
    }
    return sum((F.when(fact, POINTS[k]).otherwise(0) for k, fact in facts.items()), F.lit(0))


@query(
    f"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {HOST_SQL} AS h, page_id // 10 AS q FROM pages),
    f AS (SELECT *, trim(regexp_replace(lower(title || ' ' || url), '[^a-z0-9]+', ' ', 'g')) AS hay FROM p),
    r AS (SELECT q, page_id, 100 * contains(hay, 'the')::INT + 200 * (contains(hay, 'blog') OR contains(hay, 'page 2'))::INT + 20 * contains(hay, (q + 100)::VARCHAR)::INT
      + 50 * coalesce(h = 'm.therou.example.com', false)::INT + 1000 * (url = 'https://m.therou.example.com/en/474.html')::INT AS priority FROM f)
    SELECT q, page_id, priority, n AS pos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY priority DESC, page_id) AS n FROM r) WHERE n <= 5"""
)
def candidate_priority(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each search in order of priority, up to the budget of five fetches."""
    title, q = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.floor(F.col("page_id") / 10)
    points = priority(
        title, F.col("url"), F.lit("The"), F.array(F.lit("Blog"), F.lit(" page=2 "), F.lit("")), q + 100, F.lit("M.therou.example.com"),
        F.array(F.lit("https://m.therou.example.com/en/474.html")),
    )
    rows = read(spark, d, "pages").select(q.alias("q"), "page_id", points.alias("priority"))
    n = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("priority"), "page_id"))
    return rows.withColumn("pos", n).where("pos <= 5")


@query(
    """SELECT i.item_id, d.doc_id FROM benchmark i JOIN documents d ON contains(d.text, i.text) WHERE i.text <> ''"""
)
def benchmark_containment(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("passage"))
    docs = read(spark, d, "documents").select("doc_id", "text")
    return holders(items, docs).select("item_id", "doc_id")


def holders(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, passage) of texts (doc_id, text) that hold passages (item_id, passage).

    A passage's inner words are whole words of each text that holds it, so its longest one is a key: words meet ids by an equi-join,
    and only texts that have the word are searched. A passage of one or two words has no inner word: its longest word, or all of it where it is blank, lies inside
    a word or a run of white space of the text. The distinct ones of these are exploded to their runs of one to three characters, one of which is such a passage's key.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    by_size = lambda a: F.array_max(F.transform(a, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    inner = F.slice(words("passage"), F.lit(2), F.greatest(F.size(words("passage")) - 2, F.lit(0)))
    keyed = items.withColumn("word", by_size(inner))
    held = docs.select("doc_id", F.explode(F.array_distinct(F.concat(words("text"), F.regexp_extract_all("text", F.lit(r"\s+"), F.lit(0))))).alias("word"))
    long = keyed.where(F.col("word").isNotNull()).select("item_id", "word").join(held, "word")
    short = keyed.where(F.col("word").isNull() & (F.col("passage") != "")).select("item_id", F.coalesce(by_size(words("passage")), F.col("passage")).alias("part"))
    short = short.withColumn("key", F.substring("part", 1, 3))
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.array(*[F.substring(F.col("word"), i, F.lit(n)) for n in (1, 2, 3)]))))
    grams = held.select("word").distinct().select("word", F.explode(runs).alias("key")).join(short.select("key").distinct(), "key", "left_semi")
    short = short.join(grams, "key").where(F.col("word").contains(F.col("part"))).select("item_id", "word").distinct()
    near = long.select("item_id", "doc_id").union(short.join(held, "word").select("item_id", "doc_id")).distinct()
    met = near.join(items, "item_id").join(docs, "doc_id")
    return met.where(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id", "passage")


@query(
    """WITH b AS (SELECT item_id, item_id // 10 AS batch, length(text) AS n FROM benchmark),
    s AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY batch ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM b),
    q AS (SELECT batch, lo + n // 2 AS at, item_id AS look FROM s WHERE item_id % 3 <> 0)
    SELECT s.item_id, s.batch, s.lo, coalesce(min(q.look) FILTER (WHERE q.look IS NOT NULL), -1) AS lookup, CASE WHEN count(q.look) > 0 THEN 200 ELSE 400 END AS status
    FROM s LEFT JOIN q ON q.batch = s.batch AND q.at >= s.lo AND q.at < s.lo + s.n GROUP BY ALL"""
)
def offset_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Answers joined to the span of the request that they fall in; the batch is the equi key, unanswered spans get 400."""
    w = Window.partitionBy("batch").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    spans = read(spark, d, "benchmark").select("item_id", F.floor(F.col("item_id") / 10).alias("batch"), F.length("text").cast("bigint").alias("n"))
    spans = spans.withColumn("lo", F.coalesce(F.sum(F.col("n") + 1).over(w), F.lit(0)))
    asks = spans.where("item_id % 3 <> 0").select(F.col("batch").alias("b"), (F.col("lo") + F.floor(F.col("n") / 2)).alias("at"), F.col("item_id").alias("look"))
    within = (F.col("b") == F.col("batch")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + F.col("n"))
    return spans.join(asks, within, "left").groupBy("item_id", "batch", "lo").agg(
        F.coalesce(F.min("look"), F.lit(-1)).alias("lookup"), F.when(F.count("look") > 0, 200).otherwise(400).alias("status")
    )


@query(dealt_sql("customer", "c_custkey", [(1, True), (2, True), (3, False), (4, False)], "page, excluded", every=True))
def toa_islands(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a table of authorities: on at its heading, off at the first numbered page with a heading."""
    pages = [(1, "ii\nTable of Authorities\nRoe v. Wade"), (2, "iii\nmore {k}"), (3, "1\nARGUMENT\nRoe v. Wade, 410 U.S. {k} (1973)."), (4, "2\nText")]
    rows = dealt(spark, d, "customer", "c_custkey", pages, "page int, text string", every=True)
    return excluded_pages(rows, "k").select("k", "page", "excluded")


def clamped(spans: DataFrame, page: str, lo: str, hi: str, tie: str) -> DataFrame:
    """spans with shown_from and shown_to: in order of start, longer ones first, each clamped to begin after all before it on its page."""
    w = Window.partitionBy(page).orderBy(lo, F.desc(hi), tie).rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.coalesce(F.max(hi).over(w), F.lit(0))
    return spans.withColumn("cursor", cursor).select(*spans.columns, F.greatest(lo, "cursor").alias("shown_from"), F.greatest(hi, "cursor").alias("shown_to"))


@query(
    """WITH s AS (SELECT o_custkey AS page, o_orderkey AS id, o_orderkey % 1000 AS lo, o_orderkey % 1000 + o_orderkey % 37 + 1 AS hi FROM orders),
    c AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY page ORDER BY lo, hi DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM s)
    SELECT page, id, lo, hi, greatest(lo, cur) AS shown_from, greatest(hi, cur) AS shown_to FROM c"""
)
def span_clamp(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    spans = read(spark, d, "orders").select(F.col("o_custkey").alias("page"), k.alias("id"), (k % 1000).alias("lo"), (k % 1000 + k % 37 + 1).alias("hi"))
    return clamped(spans, "page", "lo", "hi", "id")


@query(
    dealt_sql("customer", "c_custkey", [("at 1{k}", "1{k}", 2025, "majority"), ("at 12-14, 2{k}", "12-14|2{k}", None, "dissent"), ("none", "", 1973, "unknown")], "pin, pages, year, part")
)
def citation_scalars(spark: SparkSession, d: str) -> DataFrame:
    cases = [("at 1{k}", "2025 NY Slip Op 51938(U)", "020lead"), ("at 12-14, 2{k}", "2024 and 2025", "040dissent"), ("none", "Roe (1973)", "035concurrenceinpart")]
    rows = dealt(spark, d, "customer", "c_custkey", cases, "pin string, cite string, kind string")
    return rows.select("k", "pin", F.array_join(T.pinpoints(F.col("pin")), "|").alias("pages"), T.only_year(F.col("cite")).alias("year"), T.opinion_part(F.col("kind")).alias("part"))
