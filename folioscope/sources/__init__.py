"""Scans, stores and sinks."""
