"""Incremental versions of preparation, statistics and scoring over arriving files."""
