"""Readers, sinks and the driver tables."""
