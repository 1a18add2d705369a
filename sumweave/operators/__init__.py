"""Analytical applications over aggregate batches."""
