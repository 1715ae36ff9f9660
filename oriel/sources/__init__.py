"""Reading and writing tables: tab-separated text, parquet, JDBC."""
