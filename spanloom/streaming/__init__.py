"""Continuous forms of the job operators."""
