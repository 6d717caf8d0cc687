"""Snapshot price-intelligence operators expressed as Spark plans."""
