"""Scans of landed files and the sinks that write catalogue tables back."""
