"""Readers and writers (S*): driver tables, request history, corpora, logs, indexes, models."""
