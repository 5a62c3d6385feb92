"""All registered queries of the engine and the SQL that states their results."""

from __future__ import annotations

from tessera.plans import detector_queries, ensemble_queries, metric_queries, pair_queries, parsed_queries, report_queries, selection_queries, statistics_queries, summary_queries, text_queries, variant_queries, vector_queries, verdict_queries  # noqa: F401  they register themselves
from tessera.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "pair_key"
