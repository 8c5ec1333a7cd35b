"""Whole runs, the stages they share, and the catalogue of queries."""
