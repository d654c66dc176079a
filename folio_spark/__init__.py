"""Folio: document analytics and retrieval on Spark."""
