"""Host policy with patterns as a table: hosts meet domains by their label suffixes, and globs through an automaton over the globs' literal parts.

A host is exploded to its suffixes (a.b.c, b.c, c), which equal a pattern's domain or not: an equi-join, whatever the number of patterns. Globs that are a star, a dot and a
domain are such suffixes too. Any other glob is sought by the longest of its literal parts, all of them at once, and only those found are matched. Denial comes first.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.operators.documents import HOST_SQL, glob
from sparkquill.sources.tables import read, stored

QUERIES, SQL = {}, {}
#: Globs that one automaton holds; more are gone over in turns.
GLOBS = 50_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def suffixes(host: Column) -> Column:
    """A host and what is left of it after each of its dots."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


@lru_cache(maxsize=1 << 14)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(glob(pattern), re.S)


def literal(pattern: str) -> str:
    """The longest part of a glob without signs."""
    return max(re.split(r"\[!?\]?[^\]]*\]|[*?]", pattern), key=len, default="")


def globbed(hosts: DataFrame, globs: list[str]) -> DataFrame:
    """(host, pattern) of distinct hosts and those of the globs, GLOBS at most, that they match as a whole."""
    sent = hosts.sparkSession.sparkContext.broadcast(globs)

    def run(batches):
        import ahocorasick
        import pandas as pd

        automaton, by_part, always = ahocorasick.Automaton(), {}, []
        for p in sent.value:
            part = literal(p)
            by_part.setdefault(part, []).append(p) if part else always.append(p)
        for part in by_part:
            automaton.add_word(part, part)
        automaton.make_automaton()
        for pdf in batches:
            out = []
            for host in pdf["host"]:
                near = {part for _, part in automaton.iter(host)} if by_part else ()
                for p in [*always, *(p for part in near for p in by_part[part])]:
                    if compiled(p).fullmatch(host):
                        out.append((host, p))
            yield pd.DataFrame(out, columns=["host", "pattern"])

    return hosts.select("host").mapInPandas(run, "host string, pattern string")


def matched(hosts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(host, pattern): distinct hosts and the patterns that they match. A pattern is a domain, with those under it, or a glob of the whole host.

    Hosts and patterns are taken as they are; null or empty ones match nothing.
    """
    spark = hosts.sparkSession
    some = hosts.select("host").where(F.col("host") != "").distinct()
    known = stored(patterns.select("pattern").where(F.col("pattern") != "").distinct(), "patterns")
    sign = F.col("pattern").rlike(r"[*?\[]")
    under = F.col("pattern").startswith("*.") & ~F.substring("pattern", 3, 1 << 30).rlike(r"[*?\[]")
    domains = known.where(~sign).select("pattern", F.col("pattern").alias("suffix"), F.lit(False).alias("below"))
    domains = domains.unionByName(known.where(under).select("pattern", F.substring("pattern", 3, 1 << 30).alias("suffix"), F.lit(True).alias("below")))
    each = some.select("host", F.explode(suffixes(F.col("host"))).alias("suffix"))
    found = each.join(domains, "suffix").where(~F.col("below") | (F.col("host") != F.col("suffix"))).select("host", "pattern")
    globs = known.where(sign & ~under)
    turns = -(-globs.count() // GLOBS)
    for n in range(turns):
        part = globs if turns == 1 else globs.where(F.pmod(F.xxhash64("pattern"), F.lit(turns)) == n)
        found = found.unionByName(globbed(some, sorted(r[0] for r in part.collect())))
    return found


def decided(hosts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(host, may_fetch, allowed, denied): distinct hosts; patterns (kind, pattern) of kind allow or deny. A host that any pattern denies may not be fetched."""
    found = matched(hosts, patterns).join(patterns.select("kind", "pattern").distinct(), "pattern")
    n = found.groupBy("host").agg(F.count_if(F.col("kind") == "allow").alias("allowed"), F.count_if(F.col("kind") == "deny").alias("denied"))
    some = hosts.select("host").where("host is not null").distinct().join(n, "host", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return some.select("host", ((zero("allowed") > 0) & (zero("denied") == 0)).alias("may_fetch"), zero("allowed").alias("allowed"), zero("denied").alias("denied"))


def policy(spark: SparkSession, d: str) -> DataFrame:
    """Patterns out of the tables: hosts of pages allowed with those under them, or by globs, some denied, and one for each customer that few hosts match."""
    host = T.host(F.col("url"))
    pages = read(spark, d, "pages").select("page_id", host.alias("h")).where("h is not null")
    k = F.col("page_id") % 7
    under = F.expr("substring(h, instr(h, '.') + 1)")
    made = F.when(k == 0, F.col("h")).when(k == 1, F.concat(F.lit("*."), under)).when(k == 2, F.concat(F.substring("h", 1, 4), F.lit("*"))).when(k == 3, F.concat(F.lit("?"), F.expr("substring(h, 2)")))
    made = made.when(k == 4, F.concat(F.lit("*"), F.expr("substring(h, 3, 5)"), F.lit("*."), F.expr("substring_index(h, '.', -1)")))
    rows = pages.select(F.when(F.col("page_id") % 11 == 0, "deny").otherwise("allow").alias("kind"), made.alias("pattern")).where("pattern is not null")
    c = F.col("c_custkey").cast("string")
    others = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, "deny").otherwise("allow").alias("kind"), F.concat(F.lit("c"), c, F.when(F.col("c_custkey") % 2 == 0, "*").otherwise(""), F.lit(".example.com")).alias("pattern"))
    return rows.unionByName(others).distinct()


@query(
    f"""WITH h AS (SELECT DISTINCT page_id, {HOST_SQL} AS h FROM pages),
    p AS (SELECT DISTINCT kind, pattern FROM (SELECT CASE WHEN page_id % 11 = 0 THEN 'deny' ELSE 'allow' END AS kind, CASE page_id % 7 WHEN 0 THEN h WHEN 1 THEN '*.' || substr(h, instr(h, '.') + 1) WHEN 2 THEN substr(h, 1, 4) || '*'
        WHEN 3 THEN '?' || substr(h, 2) WHEN 4 THEN '*' || substr(h, 3, 5) || '*.' || string_split(h, '.')[-1] END AS pattern FROM h WHERE h IS NOT NULL
      UNION ALL SELECT CASE WHEN c_custkey % 3 = 0 THEN 'deny' ELSE 'allow' END, 'c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE '' END || '.example.com' FROM customer) WHERE pattern IS NOT NULL),
    r AS (SELECT *, regexp_matches(pattern, '[*?]') AS sign, replace(replace(replace(pattern, '.', '\\.'), '*', '.*'), '?', '.') AS re FROM p),
    m AS (SELECT d.h, kind FROM (SELECT DISTINCT h FROM h WHERE h IS NOT NULL) d JOIN r ON CASE WHEN sign THEN regexp_full_match(d.h, re) ELSE d.h = pattern OR suffix(d.h, '.' || pattern) END)
    SELECT d.h AS host, count(m.kind) FILTER (WHERE m.kind = 'allow') > 0 AND count(m.kind) FILTER (WHERE m.kind = 'deny') = 0 AS may_fetch,
      count(m.kind) FILTER (WHERE m.kind = 'allow') AS allowed, count(m.kind) FILTER (WHERE m.kind = 'deny') AS denied FROM (SELECT DISTINCT h FROM h WHERE h IS NOT NULL) d LEFT JOIN m ON m.h = d.h GROUP BY d.h"""
)
def host_policy(spark: SparkSession, d: str) -> DataFrame:
    """Which hosts of the pages may be fetched by a table of patterns, and how many allow and deny each."""
    return decided(read(spark, d, "pages").select(T.host(F.col("url")).alias("host")), policy(spark, d))
