"""Table sources and sinks: driver fixtures, parquet/CSV tables, versioned writes."""
