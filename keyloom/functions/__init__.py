"""Scalar functions on unsigned 64-bit values kept in signed BIGINT columns."""
