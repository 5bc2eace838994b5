"""All queries of the analysis operators by name."""

from __future__ import annotations

from . import queries_audits, queries_basic, queries_profiles, queries_shortlist

MODULES = (queries_basic, queries_profiles, queries_shortlist, queries_audits)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
