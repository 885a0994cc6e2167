"""Nearest-neighbour operators over DataFrames of vectors."""
