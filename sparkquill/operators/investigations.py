"""What an investigation needs before it starts: official hosts, search phrases, mentions, policy, opinions, days, and the rewritten cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.functions import text as T
from sparkquill.operators.documents import HOST_SQL, matches
from sparkquill.operators.passages import settled
from sparkquill.sources.settings import SearchDomain, Settings, settings
from sparkquill.sources.tables import read

QUERIES, SQL = {}, {}
# fixed values: where opinions are read from, and the least characters of a text that is scored
TRUSTED, SHORTEST = "https://www.courtlistener.com/api/rest/v4/opinions/", 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def holds(text: Column, part: Column) -> Column:
    """Whether a text holds a part, whatever the case; an empty or null part is held by none."""
    return F.coalesce((part != "") & F.lower(text).contains(F.lower(part)), F.lit(False))


def official_domain(court: Column, cite: Column, rules: tuple[SearchDomain, ...]) -> Column:
    """The host of the first rule that a citation meets, by its court or by its text; null without one. Rules are settings, not data."""
    hits = [F.when(holds(court, F.lit(r.court_hint)) | holds(cite, F.lit(r.citation_marker)), r.domain) for r in rules]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def search_phrases(name: Column, parties: Column, court: Column, year: Column, docket: Column, domain: Column) -> Column:
    """At most three distinct phrases, from the widest to that of the official host; blank ones go. Nulls and empty values are left out."""
    told = lambda *parts: F.array_join(F.filter(F.concat(*parts), lambda x: x != ""), " ")
    one = lambda *c: F.array(*[x.cast("string") for x in c])
    parties = F.coalesce(parties, F.array().cast("array<string>"))
    site = F.concat(F.lit("site:"), domain, F.lit(" "), F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(F.get(parties, F.lit(0)), F.lit("")))
    phrases = F.array(told(one(name), parties, one(court, year, docket)), told(one(name, court, year)), F.when(domain != "", site).otherwise(name))
    return F.array_distinct(F.filter(phrases, lambda x: T.strip(x) != ""))


def is_mention(title: Column, snippet: Column, name: Column, court: Column, year: Column) -> Column:
    """Whether a result that isn't official names the case, and its court or year besides."""
    hay = F.concat_ws(" ", title, snippet)
    return holds(hay, T.strip(name)) & (holds(hay, court) | holds(hay, year.cast("string")))


def may_fetch(url: Column, s: Settings) -> Column:
    """A host may be fetched if it is allowed and not denied; without a host it may not."""
    return matches(T.host(url), s.allowed) & ~matches(T.host(url), s.denied)


def decision_moment(value: Column) -> Column:
    """Moment of an ISO day or time; without a zone it is UTC, and anything else is null."""
    v = T.strip(value)
    day = v.rlike(r"^\d{4}-\d\d-\d\d$")
    time = v.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?(?:Z|[+-]\d\d:\d\d)?$")
    full = F.regexp_replace(v, r"^(.{16})(Z|[+-]\d\d:\d\d)?$", "$1:00$2")  # seconds are needed where a zone follows
    zoned = F.when(v.rlike(r"(?:Z|[+-]\d\d:\d\d)$"), full).otherwise(F.concat(full, F.lit("Z")))
    return F.when(day, F.concat(v, F.lit("T00:00:00Z"))).when(time, zoned).try_cast("timestamp")


def source_link(provenance: Column, acquired: Column) -> Column:
    return F.coalesce(F.nullif(provenance, F.lit("")), F.nullif(acquired, F.lit("")))


def provenance(method: Column, at: Column, sha256: Column) -> Column:
    """How, when (an ISO moment) and as what a source was read; a time that isn't known is said so."""
    when = F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown time"))
    return F.concat(F.lit("method="), method, F.lit("; retrieved="), when, F.lit("; sha256="), sha256)


def trusted_opinions(clusters: DataFrame, listed: DataFrame, opinions: DataFrame, prefix: str = TRUSTED) -> DataFrame:
    """(id, url, text) of clusters (id, urls): opinions (url, text) of their own list, or of the one looked up (id, urls) where theirs is null.

    Addresses outside the prefix are never joined. Repeats in a list count once; clusters without opinions give nothing.
    """
    found = clusters.join(listed.select("id", F.col("urls").alias("more")), "id", "left")
    rows = found.select("id", F.explode(F.array_distinct(F.coalesce("urls", "more"))).alias("url")).where(F.col("url").startswith(prefix))
    return rows.join(opinions.select("url", "text"), "url").select("id", "url", "text")


def cache_rewrite(cites: DataFrame, cache: DataFrame, clusters: DataFrame) -> DataFrame:
    """(seq, cite, status, id) of citations (seq, cite, case_name, year) in order, from a cache (cite, status) of answers and their clusters.

    The first citation that settles an ambiguous answer rewrites it: it and all later ones of the same key read 200 and its cluster, whatever
    their own names; earlier ones stay at 300. The first settlement of a key is an aggregate that is joined back, so no task holds a key's rows
    in order.
    """
    known = cites.join(cache, "cite", "left")
    own = settled(known.where("status = 300").select("seq", "cite", "case_name", "year"), clusters, row="seq")
    first = own.where("id is not null").groupBy("cite").agg(F.min(F.struct("seq", "id")).alias("first"))
    rows = known.join(first, "cite", "left")
    done = F.coalesce((F.col("status") == 300) & (F.col("seq") >= F.col("first.seq")), F.lit(False))
    return rows.select("seq", "cite", F.when(done, 200).otherwise(F.col("status")).alias("status"), F.when(done, F.col("first.id")).alias("id"))


def parsed_lookups(answers: DataFrame) -> DataFrame:
    """(batch, nth, cite, status, lo, hi, problem) of a lookup's answers (batch, answer as JSON): a list with an object for each citation found.

    Numbers may be given as text; places that aren't given are 0. An answer that isn't a list, or holds anything but objects with a status and a
    citation, is UNAVAILABLE as a whole: one row with nothing else. Null answers are so too; an empty list gives no row.
    """
    v = F.try_parse_json("answer")
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    place = lambda x, path: F.when(get(x, path, "variant").isNull(), F.lit(0).cast("bigint")).otherwise(get(x, path, "bigint"))
    rows = F.transform(
        items,
        lambda x: F.struct(
            get(x, "$.citation", "string").alias("cite"), get(x, "$.status", "bigint").alias("status"), place(x, "$.start_index").alias("lo"), place(x, "$.end_index").alias("hi")
        ),
    )
    whole = F.forall(rows, lambda r: r["cite"].isNotNull() & r["status"].isNotNull() & r["lo"].isNotNull() & r["hi"].isNotNull())
    sound = answers.select("batch", F.when(F.coalesce(whole, F.lit(False)), rows).alias("rows"))
    good = sound.where("rows is not null").select("batch", F.posexplode("rows").alias("nth", "r")).select("batch", "nth", "r.*", F.lit(None).cast("string").alias("problem"))
    bad = sound.where("rows is null").select("batch", F.lit("UNAVAILABLE").alias("problem"))
    return good.unionByName(bad, allowMissingColumns=True)


# -- queries --------------------------------------------------------------------------------------------------------

@query(
    """WITH c AS (SELECT o_orderkey AS id, 'Case ' || o_custkey AS name, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'N.Y. App.' WHEN 2 THEN 'D. Mass.' ELSE '' END AS court,
      CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) || ' NY Slip Op ' || o_orderkey WHEN o_orderkey % 3 = 1 THEN o_orderkey || ' U.S. 1' END AS cite,
      CASE WHEN o_orderkey % 5 > 0 THEN year(o_orderdate) END AS y FROM orders),
    d AS (SELECT *, CASE WHEN contains(lower(court), 'n.y.') OR contains(lower(cite), 'ny slip op') THEN 'www.nycourts.gov' END AS domain FROM c)
    SELECT id, domain, array_to_string(list_filter([concat_ws(' ', name, nullif(cite, ''), nullif(court, ''), y::VARCHAR), concat_ws(' ', name, nullif(court, ''), y::VARCHAR),
      CASE WHEN domain IS NULL THEN name ELSE 'site:' || domain || ' ' || name || ' ' || coalesce(cite, '') END],
      lambda x, i: i = 1 OR NOT (i = 2 AND x = concat_ws(' ', name, nullif(cite, ''), nullif(court, ''), y::VARCHAR)
        OR i = 3 AND x IN (concat_ws(' ', name, nullif(cite, ''), nullif(court, ''), y::VARCHAR), concat_ws(' ', name, nullif(court, ''), y::VARCHAR)))), '|') AS phrases FROM d"""
)
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    """Official host and search phrases of orders as citations."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    court = F.when(k % 4 == 1, "N.Y. App.").when(k % 4 == 2, "D. Mass.").when(k % 4 == 3, "")
    cite = F.when(k % 3 == 0, F.concat_ws(" NY Slip Op ", year, k)).when(k % 3 == 1, F.concat(k, F.lit(" U.S. 1")))
    rows = read(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("Case "), "o_custkey").alias("name"), court.alias("court"), cite.alias("cite"), F.when(k % 5 > 0, year).alias("year"))
    rows = rows.withColumn("domain", official_domain(F.col("court"), F.col("cite"), settings().search_domains))
    phrases = search_phrases(F.col("name"), F.array("cite"), F.col("court"), F.col("year"), F.lit(None), F.col("domain"))
    return rows.select("id", "domain", F.array_join(phrases, "|").alias("phrases"))


@query(
    f"""SELECT page_id, coalesce(contains(hay, 'the') AND (contains(hay, 'blog') OR contains(hay, page_id::VARCHAR)), false) AS mention,
    coalesce(h IN ('ecfr.gov', 'uscode.house.gov', 'supremecourt.gov', 'www.nycourts.gov') OR suffix(h, '.supremecourt.gov') OR suffix(h, '.uscode.house.gov')
      OR suffix(h, '.ecfr.gov') OR suffix(h, '.www.nycourts.gov') OR suffix(h, '.uscourts.gov'), false)
      AND NOT coalesce(prefix(h, 'pacer.') OR prefix(h, 'ecf.') OR h = 'scholar.google.com' OR suffix(h, '.scholar.google.com'), false) AS may_fetch
    FROM (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || url) AS hay, {HOST_SQL.replace('url', 'u')} AS h FROM
      (SELECT page_id, html, url, CASE page_id % 4 WHEN 0 THEN 'https://ecf.uscourts.gov/' || page_id WHEN 1 THEN 'https://cand.uscourts.gov/x' WHEN 2 THEN 'http://uscourts.gov' ELSE url END AS u FROM pages))"""
)
def secondary_mention(spark: SparkSession, d: str) -> DataFrame:
    """Pages as search results: whether each is a mention of a case, and whether its host, in part an official one, may be fetched."""
    k, title = F.col("page_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    url = F.when(k % 4 == 0, F.concat(F.lit("https://ecf.uscourts.gov/"), k)).when(k % 4 == 1, "https://cand.uscourts.gov/x").when(k % 4 == 2, "http://uscourts.gov").otherwise(F.col("url"))
    mention = is_mention(title, F.col("url"), F.lit(" The "), F.lit("Blog"), k)
    return read(spark, d, "pages").select("page_id", mention.alias("mention"), may_fetch(url, settings()).alias("may_fetch"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN epoch_us(o_orderdate::TIMESTAMP) WHEN 1 THEN epoch_us(o_orderdate::TIMESTAMP) + 37800000000 WHEN 2 THEN epoch_us(o_orderdate::TIMESTAMP) + 37800000000
    WHEN 3 THEN epoch_us(o_orderdate::TIMESTAMP) + 30600500000 END AS at, 'method=web; retrieved=' || CASE WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') ELSE 'unknown time' END || '; sha256=' || sha256(o_orderkey::VARCHAR) AS provenance,
    CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'a' END AS link FROM orders"""
)
def source_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Moments of decisions in several forms, the line that tells where a source is from, and its link."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    forms = {0: day, 1: F.concat(day, F.lit("T10:30:00")), 2: F.concat(day, F.lit("T10:30Z")), 3: F.concat(day, F.lit(" 10:30:00.5+02:00")), 4: F.concat(day, F.lit("T25:00:00")), 5: F.lit("2024")}
    value = F.lit(None).cast("string")
    for n, form in forms.items():
        value = F.when(k % 6 == n, form).otherwise(value)
    at = F.when(k % 6 == 0, F.col("o_orderdate").cast("timestamp_ntz"))
    link = source_link(F.when(k % 2 == 0, F.concat(F.lit("p"), k)).otherwise(F.lit("")), F.when(k % 3 == 0, "a"))
    return read(spark, d, "orders").select(
        "o_orderkey", F.unix_micros(decision_moment(value)).alias("at"), provenance(F.lit("web"), at, F.sha2(k.cast("string"), 256)).alias("provenance"), link.alias("link")
    )


@query(
    f"""WITH u AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'https://elsewhere.example/' || o_orderkey ELSE '{TRUSTED}' || o_orderkey END AS url FROM orders)
    SELECT c_custkey AS id, count(t.k) AS opinions, coalesce(sum(t.k), 0)::BIGINT AS keys FROM customer LEFT JOIN (SELECT DISTINCT u.id, o.o_orderkey AS k FROM u JOIN orders o ON u.url = '{TRUSTED}' || o.o_orderkey) t
    ON t.id = c_custkey WHERE t.k IS NOT NULL GROUP BY c_custkey"""
)
def cluster_opinions(spark: SparkSession, d: str) -> DataFrame:
    """Customers as clusters, their orders as opinions; each other cluster's list has to be looked up."""
    k = F.col("o_orderkey")
    orders = read(spark, d, "orders").select(k, F.col("o_custkey").alias("id"))
    url = F.when(k % 7 == 0, F.concat(F.lit("https://elsewhere.example/"), k)).otherwise(F.concat(F.lit(TRUSTED), k))
    lists = orders.groupBy("id").agg(F.collect_list(url).alias("urls"))
    clusters = lists.select("id", F.when(F.col("id") % 2 == 0, F.col("urls")).alias("urls"))
    opinions = orders.select(F.concat(F.lit(TRUSTED), k).alias("url"), k.cast("string").alias("text"))
    return trusted_opinions(clusters, lists, opinions).groupBy("id").agg(F.count("*").alias("opinions"), F.sum(F.col("text").cast("bigint")).alias("keys"))


@query(
    """WITH c AS (SELECT o_orderkey AS seq, o_custkey AS cite, 'Case v. ' || o_orderkey % 5 AS name, year(o_orderdate) AS y FROM orders),
    cache AS (SELECT DISTINCT o_custkey AS cite, CASE WHEN o_custkey % 5 = 0 THEN 404 ELSE 300 END AS status FROM orders),
    k AS (SELECT c_custkey AS cite, i AS id, 'CASE V ' || (c_custkey + i) % 7 AS name, CASE WHEN i = 2 THEN '1995-01-01' END AS day FROM customer, unnest([1, 2, 3]) AS r(i)),
    own AS (SELECT seq, c.cite, min(id) AS id FROM c JOIN cache USING (cite) JOIN k ON k.cite = c.cite AND lower(replace(c.name, 'v.', 'v')) = lower(k.name)
      AND (k.day IS NULL OR k.day LIKE y || '%') WHERE status = 300 GROUP BY ALL HAVING count(*) = 1),
    f AS (SELECT cite, min(seq) AS since, arg_min(id, seq) AS id FROM own GROUP BY cite)
    SELECT seq, cite, CASE WHEN status = 300 AND seq >= since THEN 200 ELSE status END AS status, CASE WHEN status = 300 AND seq >= since THEN id END AS id FROM c JOIN cache USING (cite) LEFT JOIN f USING (cite)"""
)
def lookup_cache_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Orders as citations in order, customers as keys with three clusters each."""
    orders = read(spark, d, "orders")
    cites = orders.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("cite"), F.concat(F.lit("Case v. "), F.col("o_orderkey") % 5).alias("case_name"), F.year("o_orderdate").alias("year"))
    cache = orders.select(F.col("o_custkey").alias("cite")).distinct().withColumn("status", F.when(F.col("cite") % 5 == 0, 404).otherwise(300))
    c, i = F.col("c_custkey"), F.col("id")
    clusters = read(spark, d, "customer").select(c, F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("id")).select(
        c.alias("cite"), "id", F.concat(F.lit("CASE V "), (c + i) % 7).alias("name"), F.lit(None).cast("string").alias("name_full"), F.when(i == 2, "1995-01-01").alias("day")
    )
    return cache_rewrite(cites, cache, clusters)


@query(
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY 'page:' || event_id % 12, event_type, ts, event_id) AS pos FROM events WHERE length(trim(props)) >= 10"""
)
def signal_order(spark: SparkSession, d: str) -> DataFrame:
    """Signals of a job by section as text (page:10 before page:2), kind and time; texts under ten characters aren't scored."""
    rows = read(spark, d, "events").where(F.length(T.strip(F.col("props"))) >= SHORTEST).withColumn("section", F.concat(F.lit("page:"), F.col("event_id") % 12))
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("section", "event_type", "ts", "event_id"))
    return rows.select("user_id", "event_id", pos.alias("pos"))


@query(
    """SELECT o_orderkey AS batch, n AS nth, CASE n WHEN 0 THEN o_orderkey || ' U.S. 1' WHEN 1 THEN 'x' END AS cite, CASE n WHEN 0 THEN 200 WHEN 1 THEN 404 END AS status,
    CASE n WHEN 0 THEN 3 WHEN 1 THEN 0 END AS lo, CASE n WHEN 0 THEN 9 WHEN 1 THEN 0 END AS hi, CASE WHEN n IS NULL THEN 'UNAVAILABLE' END AS problem
    FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 5 = 2 THEN [0, 1] WHEN o_orderkey % 5 = 4 THEN [] ELSE [NULL] END) AS n FROM orders)"""
)
def lookup_contract(spark: SparkSession, d: str) -> DataFrame:
    """Orders as batches of a lookup, with sound, empty and broken answers."""
    k = F.col("o_orderkey")
    sound = F.concat(F.lit('[{"status":"200","citation":"'), k, F.lit(' U.S. 1","start_index":3,"end_index":"9"},{"status":404,"citation":"x"}]'))
    answer = F.when(k % 5 == 0, "oops").when(k % 5 == 1, "{}").when(k % 5 == 2, sound).when(k % 5 == 3, '[{"status":200,"citation":"a"},7]').otherwise("[]")
    return parsed_lookups(read(spark, d, "orders").select(k.alias("batch"), answer.alias("answer")))
