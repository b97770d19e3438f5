"""Readers that land raw files as declared-schema DataFrames."""
