"""Vocabularies of verdicts and the colours they are shown in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: which verdicts are good, bad and neutral; any other verdict is shown yellow
POSITIVE = ("VERIFIED", "VERIFIED_OFFICIAL", "VERBATIM", "VERBATIM_WITH_PERMITTED_ALTERATIONS", "SUPPORTS")
NEGATIVE = ("NOT_FOUND_ANYWHERE", "NOT_FOUND_IN_SOURCE", "CONTRADICTS")
NEUTRAL = ("NOT_IN_DATABASE", "UNRECOGNIZED", "PENDING", "SOURCE_UNAVAILABLE", "UNVERIFIABLE", "")
TONES = ("green", "grey", "yellow", "red")


def tone_rank(verdict: Column) -> Column:
    """1 green, 2 grey, 3 yellow, 4 red; null counts as neutral."""
    v = F.coalesce(verdict, F.lit(""))
    return F.when(v.isin(*POSITIVE), 1).when(v.isin(*NEUTRAL), 2).when(v.isin(*NEGATIVE), 4).otherwise(3)


def tone(verdict: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TONES)), tone_rank(verdict))


def is_issue(verdict: Column) -> Column:
    """Everything that isn't positive is listed for review, neutral verdicts too."""
    return ~F.coalesce(verdict, F.lit("")).isin(*POSITIVE)


# fixed values: verdicts that are shown in words of their own
LABELS = {
    "NOT_FOUND_ANYWHERE": "Could not be located after the available checks",
    "NOT_IN_DATABASE": "Could not be located in CourtListener",
    "NOT_FOUND_IN_SOURCE": "The quoted language does not appear in the source material reviewed",
    "ALTERED": "The quoted language differs from the source material reviewed",
    "PARAPHRASE_IN_QUOTES": "The quoted language appears similar to, but differs from, source language",
    "CONTRADICTS": "The source passages point in a different direction",
    "NOT_ADDRESSED": "The source passages reviewed do not address this point",
    "UNVERIFIABLE": "The available material did not allow verification",
    "SOURCE_UNAVAILABLE": "The source material was unavailable for this comparison",
    "AMBIGUOUS": "More than one possible source remained",
    "WEAKLY_CORROBORATED": "A matching mention was found, but the source was not verified",
}


def label(verdict: Column) -> Column:
    """A verdict in its own words, or its code with spaces for underscores and a first capital alone."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    words = F.lower(F.replace(verdict, F.lit("_"), F.lit(" ")))
    return F.coalesce(known[verdict], F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, F.lit(2), F.length(words))))


LABEL_SQL = (
    "CASE verdict " + " ".join(f"WHEN '{code}' THEN '{words}'" for code, words in LABELS.items())
    + " ELSE upper(substr(verdict, 1, 1)) || lower(replace(substr(verdict, 2), '_', ' ')) END"
)
RANK_SQL = """CASE WHEN verdict IN ('VERIFIED','VERIFIED_OFFICIAL','VERBATIM','VERBATIM_WITH_PERMITTED_ALTERATIONS','SUPPORTS') THEN 1
  WHEN verdict IN ('NOT_IN_DATABASE','UNRECOGNIZED','PENDING','SOURCE_UNAVAILABLE','UNVERIFIABLE','') THEN 2
  WHEN verdict IN ('NOT_FOUND_ANYWHERE','NOT_FOUND_IN_SOURCE','CONTRADICTS') THEN 4 ELSE 3 END"""
TONE_SQL = f"['green','grey','yellow','red'][{RANK_SQL}]"
