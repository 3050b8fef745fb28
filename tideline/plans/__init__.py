"""Composite analytical queries."""
