"""Composite reports (marts) and the batch job that builds them."""
