"""Readers. All return lazy DataFrames with fixed schemas."""
