"""Queries, their SQL, and the benchmark's repetition protocol."""
