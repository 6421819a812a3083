"""Operators on span relations."""
