"""Sources and sinks: CSV on any Hadoop file system, Parquet, JDBC, file
publishing, key upserts and JSON rows; plus the test-table role mapping."""
