"""Spark analytics for aligned sequences, torsion angles and trees."""

__version__ = "0.1.0"
