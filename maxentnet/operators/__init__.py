"""Graphs, models of them, and what is computed from either."""
