"""Column expressions (P*), policies (R*) — all built-in Spark functions."""
