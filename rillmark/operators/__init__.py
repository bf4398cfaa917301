"""Operators on stream records; each is a DataFrame transformation."""
