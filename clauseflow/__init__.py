"""Document-compliance analytics as Spark DataFrame, SQL and streaming operators."""
