"""Seeded synthetic data and audit on Spark."""

__version__ = "0.1.0"
