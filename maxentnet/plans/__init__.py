"""Builders of logical plans: pairs of nodes, and tables kept between jobs."""
