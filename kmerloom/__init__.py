"""Sequence diversity analysis on Spark."""
