"""Subpackage of foliospark."""
