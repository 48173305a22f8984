"""Relational operators over the canonical transit tables."""
