"""All queries over the driver's tables, with their SQL for comparison."""

from __future__ import annotations

from proofmill.plans import lab, rules, scoring, service, texts

QUERIES: dict = {**scoring.QUERIES, **texts.QUERIES, **lab.QUERIES, **rules.QUERIES, **service.QUERIES}
ORACLES: dict = {**scoring.ORACLES, **texts.ORACLES, **lab.ORACLES, **rules.ORACLES, **service.ORACLES}
