"""Queries and reports built from the operators."""
