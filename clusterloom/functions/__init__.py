"""Helpers that several operators share."""
