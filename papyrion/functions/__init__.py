"""Papyrion functions."""
