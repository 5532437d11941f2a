"""Where the tables of an audit come from."""

from grainwise.sources.catalog import named_table, register_tables, table_chain
from grainwise.sources.demo import demo_tables
from grainwise.sources.files import load_folder, read_table
from grainwise.sources.jdbc import JdbcSource, query_row_count
from grainwise.sources.names import local_name, sanitize_name
from grainwise.sources.sampling import (
    sample_by_key, sample_chain, sample_coverage, sample_rows, validate_sample)

__all__ = [
    "JdbcSource", "demo_tables", "load_folder", "local_name", "named_table", "query_row_count", "read_table",
    "register_tables", "sample_by_key", "sample_chain", "sample_coverage", "sample_rows",
    "sanitize_name", "table_chain", "validate_sample",
]
