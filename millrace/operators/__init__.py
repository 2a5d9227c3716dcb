"""Operators: DataFrame in, DataFrame out. Fits return a bounded model or a one-row table."""
