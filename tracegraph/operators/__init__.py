"""Relational operators over spans, nodes and edges."""
