"""All queries of the verification operators and their SQL counterparts, by name."""

from __future__ import annotations

from sparkquill.operators import candidates, citations, documents, evaluation, findings, fixlist, hosts, investigations, machines, names, offsets, passages, queues, quotes, reports, resolution, retrieval, search, verdicts
from sparkquill.sources import upserts
from sparkquill.streaming import events

MODULES = (findings, documents, search, retrieval, verdicts, citations, passages, resolution, candidates, fixlist, hosts, machines, names, offsets, queues, quotes, reports, investigations, evaluation, upserts, events)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
