"""Relational and batch operators of the core."""
