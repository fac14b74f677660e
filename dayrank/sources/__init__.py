"""Readers and writers. All schemas are declared; nothing is inferred."""
