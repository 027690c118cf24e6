"""Thresholds, budgets, hosts and rules as data: defaults here, another set from a JSON file, both checked before use."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass

# fixed values: thresholds of the checks, budgets of an investigation, hosts that may and may not be asked, rules of official addresses
DEFAULTS = {
    "quote_fidelity": {"verbatim_similarity": 0.97, "altered_similarity_min": 0.80, "paraphrase_semantic_similarity": 0.85},
    "proposition_support": {"confidence_min": 0.6, "contradicts_confidence_min": 0.75},
    "investigator": {
        "max_searches": 3, "max_fetches": 5, "max_wall_time_seconds": 90, "name_similarity_threshold": 0.80,
        "official_search_domains": [
            {"court_hint": "new york", "domain": "www.nycourts.gov"}, {"court_hint": "n.y.", "domain": "www.nycourts.gov"},
            {"citation_marker": "ny slip op", "domain": "www.nycourts.gov"},
        ],
    },
    "retrieval": {"top_k_paragraphs": 6},
    "allowed": ["supremecourt.gov", "*.uscourts.gov", "uscode.house.gov", "ecfr.gov", "www.nycourts.gov"],
    "denied": ["pacer.*", "ecf.*", "scholar.google.com"],
    "resolvers": [
        {
            "name": "ny_reporter_3d",
            "citation_pattern": r"(?<!\d)(?P<year>\d{4})\s+N\.?(?:Y\.?|Y)\s+Slip\s+Op\s+(?P<number>\d+)(?:\([A-Z]\))?",
            "url_template": "https://www.nycourts.gov/reporter/3dseries/{year}/{year}_{number}.htm",
        }
    ],
}


@dataclass(frozen=True)
class SearchDomain:
    """A host to search for citations whose court holds the hint, or whose text holds the marker."""

    domain: str
    court_hint: str = ""
    citation_marker: str = ""


@dataclass(frozen=True)
class Resolver:
    name: str
    citation_pattern: str
    url_template: str


@dataclass(frozen=True)
class Settings:
    verbatim: float
    altered: float
    paraphrase: float
    confidence: float
    contradiction: float
    searches: int
    fetches: int
    seconds: float
    name_similarity: float
    paragraphs: int
    search_domains: tuple[SearchDomain, ...]
    allowed: tuple[str, ...]
    denied: tuple[str, ...]
    resolvers: tuple[Resolver, ...]


def _number(given: Mapping, part: str, name: str, low: float, high: float) -> float:
    """A number of a part within its bounds; anything else, a boolean too, is an error that names it."""
    x = given[part].get(name) if isinstance(given.get(part), Mapping) else None
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or not low <= x <= high:
        raise ValueError(f"{part}.{name}: a number from {low} to {high} is needed, not {x!r}")
    return float(x)


def _records(items, part: str, kind, needed: tuple[str, ...]) -> tuple:
    """Items as records of one kind; the needed fields, and any others that it knows, are text."""
    fields, out = tuple(kind.__dataclass_fields__), []
    for item in items if isinstance(items, list) else [None]:
        known = {k: v for k, v in item.items() if k in fields and v is not None} if isinstance(item, Mapping) else {}
        if not all(known.get(k) for k in needed) or not all(isinstance(v, str) for v in known.values()):
            raise ValueError(f"{part}: {', '.join(needed)} are needed, as text, not {item!r}")
        out.append(kind(**known))
    return tuple(out)


def settings(given: Mapping | None = None) -> Settings:
    """Checked settings of a mapping of DEFAULTS' shape; parts that it lacks are taken from DEFAULTS, parts that it has are taken whole."""
    g = {**DEFAULTS, **(given or {})}
    share = lambda part, name: _number(g, part, name, 0.0, 1.0)
    most = lambda part, name: _number(g, part, name, 0, 1e9)
    domains = _records(g["investigator"].get("official_search_domains", []), "official_search_domains", SearchDomain, ("domain",))
    if not all(d.court_hint or d.citation_marker for d in domains):
        raise ValueError("official_search_domains: a court_hint or a citation_marker is needed")
    for part in ("allowed", "denied"):
        if not isinstance(g[part], list) or not all(isinstance(x, str) for x in g[part]):
            raise ValueError(f"{part}: a list of hosts is needed, as text")
    rules = _records(g["resolvers"], "resolvers", Resolver, ("name", "citation_pattern", "url_template"))
    for rule in rules:
        re.compile(rule.citation_pattern)
    out = Settings(
        share("quote_fidelity", "verbatim_similarity"), share("quote_fidelity", "altered_similarity_min"), share("quote_fidelity", "paraphrase_semantic_similarity"),
        share("proposition_support", "confidence_min"), share("proposition_support", "contradicts_confidence_min"),
        int(most("investigator", "max_searches")), int(most("investigator", "max_fetches")), most("investigator", "max_wall_time_seconds"),
        share("investigator", "name_similarity_threshold"), int(most("retrieval", "top_k_paragraphs")), domains, tuple(g["allowed"]), tuple(g["denied"]), rules,
    )
    if out.altered > out.verbatim:
        raise ValueError("quote_fidelity: altered_similarity_min is over verbatim_similarity")
    return out


def load(path: str) -> Settings:
    """Settings of a JSON file that the driver can read."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if not isinstance(given, dict):
        raise ValueError(f"{path}: an object is needed")
    return settings(given)
