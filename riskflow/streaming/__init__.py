"""Staged JSON processing, in one batch or as micro-batches."""
