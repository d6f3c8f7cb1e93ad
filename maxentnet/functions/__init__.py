"""Column functions: link probabilities and reproducible uniform numbers."""
