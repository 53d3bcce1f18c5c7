"""Papyrion plans."""
