"""Relational building blocks: versioning, selection, windows, discovery, maintenance."""
