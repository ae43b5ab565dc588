"""All registries of the core library."""

from __future__ import annotations

from brindle.plans import answer_queries, audit_queries, content_queries, metric_queries, report_queries, rolling_queries

REGISTRIES = [rolling_queries.REG, metric_queries.REG, answer_queries.REG, content_queries.REG, audit_queries.REG, report_queries.REG]
