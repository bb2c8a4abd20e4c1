"""Keyed upserts as streams."""
