"""Assembled query plans: the named query catalog and reports."""
