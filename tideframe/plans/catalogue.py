"""All registered queries of the time-series operators, each beside its SQL."""

from __future__ import annotations

from tideframe.plans import field_queries, frame_queries, layout_queries, match_queries, model_queries, rule_queries, series_queries, spatial_queries, stats_queries, table_queries, time_queries

_ALL = (time_queries, series_queries, match_queries, stats_queries, table_queries, field_queries, rule_queries, model_queries, layout_queries, spatial_queries, frame_queries)
QUERIES = {name: q for m in _ALL for name, q in m.query.queries.items()}
ORACLE_SQL = {name: q for m in _ALL for name, q in m.query.sql.items()}
