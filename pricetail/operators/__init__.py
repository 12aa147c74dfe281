"""Operators on DataFrames: cleaning, cells, shares, products, dynamics, geography, estimation."""
