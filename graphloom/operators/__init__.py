"""Relational and graph operators over program-fact tables."""
