"""Table and memo sources and sinks, and the site catalog."""

from lotwise.sources.catalog import multi_site_tables, read_site_table, site_catalog
from lotwise.sources.tables import (
    empty_table,
    read_csv,
    read_memo,
    read_table,
    write_csv,
    write_memo,
    write_parquet,
    write_samples,
)

__all__ = [
    "empty_table",
    "multi_site_tables",
    "read_csv",
    "read_memo",
    "read_site_table",
    "read_table",
    "site_catalog",
    "write_csv",
    "write_memo",
    "write_parquet",
    "write_samples",
]
