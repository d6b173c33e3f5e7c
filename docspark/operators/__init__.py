"""Operators over the engine's tables: DataFrames in, a lazy DataFrame out."""
