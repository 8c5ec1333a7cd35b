"""Readers for raw records and sinks for published tables."""
