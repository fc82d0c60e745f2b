"""Whole programs: ingest, search, ask, and the registered queries."""
