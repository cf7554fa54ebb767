"""DuckDB statements that every SQL-expressible query must agree with."""
