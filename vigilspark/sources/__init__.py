"""Ledger files, and parsers of feeds, listings and report pages."""
