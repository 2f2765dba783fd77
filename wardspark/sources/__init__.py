"""Scans and sinks, plus portable fixture views over the driver tables."""
