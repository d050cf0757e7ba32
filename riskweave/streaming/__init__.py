"""Streaming forms of the labelling and batch-log jobs."""
