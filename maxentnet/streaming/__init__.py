"""Marginals of edge streams."""
