"""Native text expressions: normal forms, redaction, lint, hosts, years, pinpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns and replacements of the redaction, in order
REDACTIONS = (
    (r"\bsk-[A-Za-z0-9_-]{12,}\b", "[redacted secret]"),
    (r"(?i)\b(?:postgres(?:ql)?|redis)://[^\s|)]+", "[redacted connection string]"),
    (r"\b[A-Za-z]:\\[^\s|)]+", "[redacted local path]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[redacted email]"),
)
# fixed values: words that no export may hold
DENIED = (r"(?i)\bfabricat\w*\b", r"(?i)\bfake\b", r"(?i)\b(?:lied|lying|liar)\b", r"(?i)\bAI[ -]?generated\b", r"(?i)\b(?:cheated|cheating|cheater)\b")


#: White space of Unicode, and the separators \x1c to \x1f.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same for DuckDB's patterns.
SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# fixed values: characters of a page that count as plain quotes and dashes
PAGE_SINGLE, PAGE_DOUBLE, PAGE_DASH = "\u2018\u2019\u201a\u201b", "\u201c\u201d\u201e\u201f", "\u2010\u2011\u2012\u2013\u2014\u2212"
PAGE_FROM = PAGE_SINGLE + PAGE_DOUBLE + PAGE_DASH
PAGE_TO = "'" * len(PAGE_SINGLE) + '"' * len(PAGE_DOUBLE) + "-" * len(PAGE_DASH)


def strip(text: Column) -> Column:
    """Without white space at the ends, line breaks and tabs too."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def match_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, f"{SPACE}+", ""))


def discovery_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def docket_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def page_form(text: Column) -> Column:
    """Words broken over lines joined, dashes and quotes plain, white space squashed."""
    joined = F.regexp_replace(text, r"[-\u2010\u2011][\r\n](\p{L})", "$1")
    return squash(F.translate(joined, PAGE_FROM, PAGE_TO))


def redact(text: Column) -> Column:
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, F.lit(mark))
    return squash(text)


def cell(text: Column) -> Column:
    return F.replace(redact(text), F.lit("|"), F.lit("\\|"))


def denied_words(text: Column) -> Column:
    """Distinct denied words in a text, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in DENIED]))))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def host(url: Column) -> Column:
    """Lower-case host of a plain http or https URL; null for other schemes, user info and malformed URLs."""
    found = F.regexp_extract(F.lower(url), r"^https?://([^/?#@\s:]+)(?::\d+)?(?:[/?#].*)?$", 1)
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def only_year(text: Column) -> Column:
    """The one distinct year from 1600 to 2099 that stands alone in a text; null if there are several or none."""
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)(?:1[6-9]|20)\d\d(?!\d)"), F.lit(0)))
    return F.when(F.size(years) == 1, years[0].cast("int"))


def pinpoints(text: Column) -> Column:
    """Pages of the first pinpoint, such as 'at 155-56, 160'."""
    first = F.regexp_extract(text, r"(?:at )?(\d+(?:[-–]\d+)?(?:,\s*\d+(?:[-–]\d+)?)*)", 1)
    return F.filter(F.transform(F.split(first, ","), lambda x: F.trim(x)), lambda x: x != "")


def opinion_part(kind: Column) -> Column:
    # fixed values: prefixes of opinion types
    parts = {"010combined": "majority", "015unamimous": "majority", "020lead": "majority", "025plurality": "majority", "030concurrence": "concurrence", "040dissent": "dissent"}
    out = F.lit(None).cast("string")
    for prefix, part in parts.items():
        out = F.when(kind.startswith(prefix), part).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))
