"""Whole flows: a table in, a prepared table and its run record out."""
