"""Structured Streaming queries: ingest (Q1), late splitter (Q2), window aggregate (Q3)."""
