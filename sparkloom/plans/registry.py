"""Every query of the library by name, and the SQL that gives the same rows."""

from sparkloom.plans import answering, chunks, gating, graphs, hard, layouts, loading, parsing, quality, questions, reports, retrieval, scoring, streams, texts, windows  # noqa: F401  they register their queries
from sparkloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
