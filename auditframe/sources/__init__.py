"""Readers, layout detection and sinks."""
