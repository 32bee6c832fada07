"""Incremental forms of the cell and event aggregates."""
