"""Recommendation catalogues from conversation logs, contact cards and bulletins, on Spark."""
