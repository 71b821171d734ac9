"""Readers with row checks, and sinks."""
