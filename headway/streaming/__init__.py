"""Structured Streaming front for arriving stop times."""
