"""Ledgerline: provenance-aware entity, claim and geometry analytics on Spark."""

__version__ = "0.1.0"
