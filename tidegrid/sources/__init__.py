"""Scans of landed tables and files, and the sinks."""
