"""Registered queries: one per inventory item, each with its DuckDB oracle SQL where SQL can say it."""
