"""Column expressions: no job, no Python worker, only Spark SQL functions."""
