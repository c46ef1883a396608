"""Sources: schemas, the Tables bundle and readers."""

from creditlens.sources.schema import SCHEMAS, DOMAINS, PRIMARY_KEYS, FOREIGN_KEYS
from creditlens.sources.tables import Tables, read_tables, tables_from_rows, write_tables
from creditlens.sources.star_mapping import from_star_schema

__all__ = ["SCHEMAS", "DOMAINS", "PRIMARY_KEYS", "FOREIGN_KEYS", "Tables",
           "read_tables", "tables_from_rows", "write_tables", "from_star_schema"]
