"""Operators over statements, references, classes, lists, identifiers and graphs."""
