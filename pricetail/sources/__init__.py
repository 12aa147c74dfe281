from .readers import read_csv_table, read_months, read_parquet_table, read_parquet_tree
from .writers import replace_months, write_bucketed, write_csv_table, write_months

__all__ = [
    "read_csv_table",
    "read_months",
    "read_parquet_table",
    "read_parquet_tree",
    "replace_months",
    "write_bucketed",
    "write_csv_table",
    "write_months",
]
