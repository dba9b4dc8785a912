"""Relational and graph operators over page and link tables."""
