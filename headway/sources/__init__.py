"""Readers for schedule feeds."""
