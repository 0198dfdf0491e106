"""Deterministic search over security-event metadata on Spark."""
