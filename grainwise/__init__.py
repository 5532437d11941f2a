"""Join fan-out audits over Spark tables."""

from grainwise.errors import AuditError
from grainwise.functions.dates import next_month, register_functions
from grainwise.operators.audit import AuditResult, audit
from grainwise.operators.fixes import count_chain
from grainwise.operators.profile import exact_duplicates, key_stats, top_keys
from grainwise.operators.rewrites import keep_latest, pre_aggregate, rewrite_chain
from grainwise.operators.sections import QueryResult, audit_query, audit_sections
from grainwise.plans.spec import Agg, Join, JoinChain

__all__ = [
    "Agg", "AuditError", "AuditResult", "Join", "JoinChain", "QueryResult", "audit", "audit_query",
    "audit_sections", "count_chain", "exact_duplicates", "keep_latest", "key_stats", "next_month",
    "pre_aggregate", "register_functions", "rewrite_chain", "top_keys",
]
