"""Sources and sinks: delimited files of unknown shape, and versioned Parquet tables."""
