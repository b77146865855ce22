"""Incident analytics on PySpark: contract checks, windowed detection, incident timelines and their reports."""

__version__ = "0.1.0"
