"""Access traces as text, tagged traces as partitioned Parquet, and any table
with a key and an order as an access table."""
