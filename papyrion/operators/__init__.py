"""Papyrion operators."""
