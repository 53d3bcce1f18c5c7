"""Papyrion streaming."""
