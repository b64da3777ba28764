"""Surveillance analytics and corpus preparation on Spark."""
