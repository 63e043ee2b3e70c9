"""Table and stream sources."""
