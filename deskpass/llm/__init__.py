"""Operators for training-data pipelines: deduplication, sharding, surrogates,
quality, packing, extraction, licences, decontamination and language ID.

Nothing else in the package imports this subpackage."""
