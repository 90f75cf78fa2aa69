"""Fathom: queries over semi-structured text, planned and run by Spark."""

__version__ = "0.1.0"
