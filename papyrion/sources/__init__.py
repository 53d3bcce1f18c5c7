"""Papyrion sources."""
