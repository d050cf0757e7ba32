"""Operators of a training-data pipeline: clean, deduplicate, label, mix and encode documents, search vectors."""
