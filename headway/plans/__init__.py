"""Compositions of operators into whole pipelines."""
