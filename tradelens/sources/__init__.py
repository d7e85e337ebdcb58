"""Contract schemas, loaders (parquet, JDBC, catalog), static dimensions, test-data derivation."""
