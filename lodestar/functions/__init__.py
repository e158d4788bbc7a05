"""Column expressions with the semantics of the SQL dialect where Spark's own differ."""
