"""Shared passes over the input table; every operator is built on these."""
