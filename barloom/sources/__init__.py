"""Readers, writers and the cut of a plan by a written table."""
