"""Whole pipelines and dashboard queries composed from the operators."""
