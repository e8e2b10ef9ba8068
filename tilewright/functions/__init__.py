"""Subpackage of the tile engine."""
