"""Sources and sinks: parquet tables, adapter views, CSV / JSON files."""
