"""Relational, text, vector and ranking operators over DataFrames."""
