"""Compositions of operators: feature tables, jobs, and the catalogue of queries."""
