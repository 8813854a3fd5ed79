"""Grammars of lockfiles: each takes (path, text) and gives package rows as dictionaries."""
