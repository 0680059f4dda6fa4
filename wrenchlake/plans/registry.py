"""All registered queries of the reference's operators, and their DuckDB equivalents."""

from wrenchlake.plans import feature_queries, model_queries, more_queries, record_queries, retrieval_queries, scan_queries, text_queries

_PARTS = (model_queries, text_queries, retrieval_queries, more_queries, record_queries, feature_queries, scan_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
