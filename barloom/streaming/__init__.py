"""Structured Streaming forms of the batch operators; an addition, as the results to match are batch only."""
