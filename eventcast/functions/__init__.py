"""Column-level functions built from Spark expressions."""
