"""DataFrame operators: joins, set ops, windows, metrics, text, vectors, models."""
