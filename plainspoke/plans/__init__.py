"""Logical tables and whole queries."""
